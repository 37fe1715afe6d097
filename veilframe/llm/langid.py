"""Language of each sentence, segment and document by a byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows, the maximum over
the window feeds a softmax. The network is trained in numpy on labelled text: the clean
sentences of ``lang_samples`` and a bounded sample of requests with their own labels
(``SAMPLE`` texts, chosen by a hash of their id). Those labels are partly wrong, so
before training each sentence gets the label under which its words mostly occur.

A text is cut into sentences; a sentence's confidence is the mean probability over its
windows. What has words but is no whole sentence (a greeting, a heading, a name) is classified
too and needs clear evidence to differ from the sentences around it. Neighbouring stretches of
one language form a segment; the document takes the language with the most characters. What has no words (null, empty, numbers, codes) gets
no language: no segments, and a null language with confidence 0.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.arrow import map_rows, sample
from veilframe.llm.lookalikes import INVISIBLE, SAME_SHAPE

LANGS = ("en", "de", "fr", "es", "it", "pt", "nl", "ru", "zh", "ja")
SAMPLE = 12_000  # labelled texts the driver reads for training
LONGEST_SAMPLE = 20_000  # characters; longer texts are not trained on
PER_LANGUAGE = 1_500  # windows a language and epoch
REMEMBERED = 60_000  # sentences kept by a worker before it starts anew

# How labels name the languages: codes, English names, own names.
NAMES = """
en eng english   de deu ger german deutsch   fr fra fre french français francais   es spa spanish español espanol castellano
it ita italian italiano   pt por portuguese português portugues   nl nld dut dutch nederlands   ru rus russian русский
zh zho chi cmn yue chinese mandarin cantonese 中文 汉语 漢語 普通话 國語 国语 华语   ja jpn jap japanese 日本語 にほんご
"""
LABELS = {name: group.split()[0] for group in re.split(r"   +|\n", NAMES.strip()) for name in group.split()}


def labelled(label: Column) -> Column:
    """The languages a label names, as an array; null, blank and placeholder labels name none."""
    table = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    parts = F.split(F.lower(F.trim(F.coalesce(label, F.lit("")))), r"[/,;|+&]")

    def one(p):
        p = F.trim(p)
        return F.coalesce(F.try_element_at(table, p), F.try_element_at(table, F.regexp_extract(p, r"^([^-_\s.(]+)", 1)))

    return F.array_compact(F.transform(parts, one))


def label_language(label: str | None) -> str | None:
    p = (label or "").strip().lower()
    return LABELS.get(p) or LABELS.get(re.split(r"[-_\s.(]", p)[0])


# ---- sentences ----

_END = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|$)|[。！？]+[”’」』）]*|[\n\r]+")
_INITIAL = re.compile(r"(?:^|[^\w])[^\W\d_]\.$")
_LEAD = " \t\n\r /|-–—•*;,"
_DOMAINS = "com|net|org|info|edu|gov|int|eu|io|de|fr|es|it|pt|nl|ru|cn|jp|uk|us|br|ch|at|be|example|test|invalid"  # Fixed values: ends of addresses
_NOISE = re.compile(  # runs of ASCII that are addresses, links or numbers; each run is looked at once
    r"(?<![!-~])(?:[!-~]++ ?(?:[(\[]at[)\]]|[(\[]@[)\]]|@) ?[!-~]++|[!-~]++ at [!-~]++(?: dot [!-~]++)+"
    r"|(?=[!-~]*?(?:[@\d]|://|[(\[]at[)\]]|\.(?:" + _DOMAINS + r")\b))[!-~]++)",
    re.IGNORECASE,
)
_MAYBE_NOISE = re.compile(r"[@\d]|://|[(\[]at[)\]]|\.(?:" + _DOMAINS + r")\b| dot ", re.IGNORECASE)  # none of it: no noise
_GAP = re.compile(r"[^\w]+")
_WIDE = re.compile("[぀-ヿㇰ-ㇿ㐀-鿿豈-﫿ｦ-ﾟ]")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_TOKEN = re.compile(r"[^\w]*[^\W\d_]+(?:[.'’-][^\W\d_]+)*[^\w]*")
_MARKS = " \t*_\"'”’»)]"
_OUTER = "\"'“”‘’«»„‚()[]{}<>.,;:!?¿¡…-–—"
_NONLATIN = re.compile("[Ͱ-ԯ]")
_GONE = dict.fromkeys(map(ord, INVISIBLE))
_TO_LATIN = {ord(o): g.split()[0] for g in re.split(r"  +|\n", SAME_SHAPE.strip()) for o in g.split()[1:]}


_HIDDEN = re.compile("[" + "".join(map(re.escape, INVISIBLE)) + "]")


def _shown(text: str) -> str:
    return text.translate(_GONE) if not text.isascii() and _HIDDEN.search(text) else text


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, without outer blanks."""
    out, at = [], 0

    def take(end):
        start = at
        while start < end and text[start] in _LEAD:
            start += 1
        stop = end
        while stop > start and text[stop - 1].isspace():
            stop -= 1
        if stop > start:
            out.append((start, stop))

    for m in _END.finditer(text):
        # the full stop of an initial ends no sentence
        if m.group() == "." and _INITIAL.search(text, max(at, m.end() - 4), m.end()) and text[m.end() - 2].isupper():
            continue
        take(m.end())
        at = m.end()
    take(len(text))
    return out


def plain(sentence: str) -> str:
    """What the network reads: one width and case, no invisible characters, no addresses and numbers."""
    if not sentence.isascii():
        sentence = unicodedata.normalize("NFKC", _shown(sentence))
        if _NONLATIN.search(sentence):
            # look-alikes among Latin letters: few letters remain that only the other script has
            latin = sentence.translate(_TO_LATIN)
            if 4 * len(_NONLATIN.findall(latin)) < sum(c.isascii() and c.isalpha() for c in latin) and any(c.isascii() and c.isalpha() for c in sentence):
                sentence = latin
    return _GAP.sub(" ", _quiet(sentence, " 0 ")).strip().lower()


def _quiet(text: str, put: str) -> str:
    return _NOISE.sub(put, text) if _MAYBE_NOISE.search(text) else text


def _words_of(given: str) -> list[str]:
    return [w for w in _quiet(_shown(given), " ").replace("/", " ").split() if len(w) <= LONGEST_WORD and _TOKEN.fullmatch(w)]


def is_sentence(sentence: str, given: str) -> bool:
    """Whether a plain sentence is one: enough words, and not only names and labels.

    Five words or eight Han or kana characters. In scripts with case, a name or contact line
    has hardly any word in lower case.
    """
    wide = len(_WIDE.findall(sentence))
    if wide >= 8:
        return (given.rstrip(_MARKS)[-1:] in "。！？!?.…" or bool(_GRAMMAR.search(given)))
    # fewer such characters may be a name in a sentence of words
    words = [w.strip(_OUTER) for w in _words_of(given)]
    if len(words) < 5:
        return False
    small = sum(w[0].islower() for w in words)
    shouted = all(w.isupper() for w in words)
    if given.rstrip(_MARKS)[-1:] not in ".!?…":
        return small >= 5
    return shouted or small >= 3 or (small >= 2 and small * 2 >= len(words) - 1)


# ---- the network ----

_GRAMMAR = re.compile("[的了是我们把她他不這这]|[ぁ-ん]{2}")  # words that only sentences have
LONGEST_WORD = 30
WINDOW, STRIDE, DIM, FILTERS, WIDTHS = 64, 60, 12, 48, (2, 3, 4, 5)  # windows share what the widest filter needs


def windows(text: str) -> np.ndarray:
    data = (" " + text + " ").encode()
    starts = range(0, max(1, len(data) - WINDOW + STRIDE), STRIDE)
    out = np.full((len(starts), WINDOW), 32, np.uint8)
    for row, at in zip(out, starts):
        part = data[at : at + WINDOW]
        row[: len(part)] = np.frombuffer(part, np.uint8)
    return out


@dataclass
class Network:
    weights: dict

    @classmethod
    def new(cls, classes: int, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        w = {"E": rng.normal(0, 0.5, (256, DIM))}
        for k in WIDTHS:
            w[f"W{k}"] = rng.normal(0, (2 / (k * DIM)) ** 0.5, (k * DIM, FILTERS))
            w[f"b{k}"] = np.zeros(FILTERS)
        w["V"] = rng.normal(0, 0.05, (FILTERS * len(WIDTHS), classes))
        w["c"] = np.zeros(classes)
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        w, pooled = self.weights, []
        e = w["E"][x]
        for k in WIDTHS:
            cols = np.lib.stride_tricks.sliding_window_view(e, k, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WINDOW - k + 1, k * DIM)
            h = cols.reshape(-1, k * DIM) @ w[f"W{k}"]
            h = h.reshape(len(x), WINDOW - k + 1, FILTERS)
            at = h.argmax(1) if keep is not None else None
            top = (np.take_along_axis(h, at[:, None, :], 1)[:, 0] if keep is not None else h.max(1)) + w[f"b{k}"]
            pooled.append(np.maximum(top, 0))
            if keep is not None:
                keep.append((cols, at))
        p = np.concatenate(pooled, 1)
        if keep is not None:
            keep.append(p)
        z = p @ w["V"] + w["c"]
        z -= z.max(1, keepdims=True)
        z = np.exp(z)
        return z / z.sum(1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, rate: float = 0.003, seed: int = 3) -> Network:
        rng, w = np.random.default_rng(seed), self.weights
        m, v, t = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
        for epoch in range(epochs):
            order = _balanced(y, rng)
            pace = rate * (1 - 0.8 * epoch / epochs)
            for at in range(0, len(order), 128):
                rows = order[at : at + 128]
                keep: list = []
                xb = x[rows]
                p = self.forward(xb, keep)
                d = p.copy()
                d[np.arange(len(rows)), y[rows]] -= 1
                d /= len(rows)
                pool = keep.pop()
                g = {"V": pool.T @ d, "c": d.sum(0)}
                dp = (d @ w["V"].T) * (pool > 0)
                ge = np.zeros((256, DIM), np.float32)
                n = np.arange(len(rows))[:, None]
                for j, k in enumerate(WIDTHS):
                    cols, best = keep[j]
                    dk = dp[:, j * FILTERS : (j + 1) * FILTERS]
                    g[f"b{k}"] = dk.sum(0)
                    g[f"W{k}"] = np.einsum("nf,nfc->cf", dk, cols[n, best], optimize=True)
                    back = dk[:, :, None] * w[f"W{k}"].T[None]
                    seen = xb[n[:, :, None], best[:, :, None] + np.arange(k)].ravel()
                    back = back.reshape(-1, DIM)
                    for q in range(DIM):
                        ge[:, q] += np.bincount(seen, back[:, q], 256)
                g["E"] = ge
                t += 1
                for key, grad in g.items():
                    m[key] += 0.1 * (grad - m[key])
                    v[key] += 0.001 * (grad * grad - v[key])
                    w[key] -= (pace * (m[key] / (1 - 0.9**t)) / (np.sqrt(v[key] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def _balanced(y: np.ndarray, rng) -> np.ndarray:
    """A shuffled epoch with equally many rows of each class present."""
    groups = [np.flatnonzero(y == c) for c in np.unique(y)]
    n = min(PER_LANGUAGE, max([400, *map(len, groups)]))
    return rng.permutation(np.concatenate([rng.choice(g, n, replace=len(g) < n) for g in groups]))


class Identifier:
    def __init__(self, network: Network):
        self.network = network
        self.seen: dict[str, np.ndarray] = {}
        self.clear: dict[str, tuple[int, float]] = {}  # verdicts that need no look at the rest of the text
        self.judged: dict[str, tuple[str, bool, bool]] = {}

    def judge(self, given: str) -> tuple[str, bool, bool]:
        """(plain form, whether a whole sentence, whether it has words) of a sentence, remembered."""
        got = self.judged.get(given)
        if got is None:
            if len(self.judged) >= REMEMBERED:
                self.judged.clear()
            p = plain(given)
            whole = is_sentence(p, given)
            got = (p, whole, whole or bool(_words_of(given) or _WIDE.search(p)))
            if len(given) <= 400:
                self.judged[given] = got
        return got

    def classify(self, texts: list[str]) -> None:
        """Fills ``seen`` for plain sentences, in batches of windows."""
        new = [t for t in dict.fromkeys(texts) if t not in self.seen]
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen.clear(), self.clear.clear()
            new = list(dict.fromkeys(texts))
        for at in range(0, len(new), 256):
            part = new[at : at + 256]
            blocks = [windows(t) for t in part]
            p = np.concatenate([self.network.forward(b) for b in np.array_split(np.concatenate(blocks), max(1, sum(map(len, blocks)) // 512))])
            sizes = np.array([len(b) for b in blocks])
            v = np.exp(np.add.reduceat(np.log(p + 1e-6), np.cumsum(sizes) - sizes) / sizes[:, None])
            v /= v.sum(1, keepdims=True)
            for t, row, best, sure in zip(part, v, v.argmax(1).tolist(), v.max(1).tolist()):
                self.seen[t] = row
                if sure >= SURELY:
                    self.clear[t] = (best, sure)

    def verdicts(self, found: list[tuple]) -> list[tuple[int, float]]:
        """(language, confidence) of each stretch; an unclear one, or one that is no whole sentence, leans on the sentences of its text."""
        clear = [self.clear.get(f[2]) if f[3] else None for f in found]
        if None not in clear:
            return clear
        each = np.array([self.seen[f[2]] for f in found])
        sentence = np.array([f[3] for f in found], bool)
        size = np.array([min(f[1] - f[0], 200) for f in found], float) * (sentence if sentence.any() else 1)
        whole = (each * size[:, None]).sum(0) / size.sum()
        leaning = each * (whole + 0.05)
        leaning /= leaning.sum(1, keepdims=True)
        unclear = (each.max(1) < SURELY) | (~sentence & sentence.any())
        each[unclear] = leaning[unclear]
        return list(zip(each.argmax(1).tolist(), each.max(1).tolist()))

    def document(self, found: list[tuple[int, int, str, bool]]) -> list[tuple]:
        """(start, end, language, confidence, has a whole sentence) of the segments, from (start, end, plain, whole)."""
        out: list[list] = []
        for (start, end, _, whole), (best, sure) in zip(found, self.verdicts(found) if found else ()):
            n = end - start
            if out and out[-1][2] == best:
                last = out[-1]
                last[3] = (last[3] * (last[1] - last[0]) + sure * n) / (last[1] - last[0] + n)
                last[1], last[4] = end, last[4] or (whole and sure >= SURE)
            else:
                out.append([start, end, best, sure, whole and sure >= SURE])
        return [(a, b, LANGS[c], sure, whole) for a, b, c, sure, whole in out]

    def segments(self, texts: list[str | None]) -> list[list[tuple]]:
        cut = []
        for t in texts:
            rows = []
            for a, b in sentences(t) if t else ():
                p, whole, wordy = self.judge(t[a:b])
                if whole or _WORD.search(p.replace("0", " ")):
                    rows.append((a, b, p, whole, wordy))
            if any(r[3] for r in rows):
                # beside sentences, a code or link alone has no language
                rows = [r for r in rows if r[3] or r[4]]
            cut.append([r[:4] for r in rows])
        self.classify([r[2] for rows in cut for r in rows])
        missing = [r[2] for rows in cut for r in rows if r[2] not in self.seen]
        if missing:
            self.classify(missing)
        return [self.document(rows) for rows in cut]


SURELY = 0.9  # from this confidence on a sentence stands for itself
SURE = 0.5  # least confidence of a sentence that counts as found
CLEAR = 0.8  # least confidence of another stretch whose language counts for the document


def fit(samples: list[tuple[str, str]], texts: list[tuple[str, str]], epochs: int = 4) -> Network:
    """samples: clean (language, sentence); texts: (language, text) with partly wrong labels."""
    rows = [(plain(text[a:b]), LANGS.index(lang)) for lang, text in texts for a, b in sentences(text) if is_sentence(plain(text[a:b]), text[a:b])]
    known = [(plain(text), LANGS.index(lang)) for lang, text in samples]
    x, y = [], []
    for n, (text, c) in enumerate(known * 3 + corrected(rows, known)):
        for w in windows(_bare(text) if n % 4 == 0 else text):
            x.append(w), y.append(c)
    return Network.new(len(LANGS)).train(np.array(x), np.array(y), epochs)


def corrected(rows: list[tuple[str, int]], known: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Sentences with the label that their words have in most places.

    Of all sentences with a word, most carry the right label, so the words of a sentence
    outvote a wrong label of its text. Undecided sentences are left out. Characters in pairs
    stand for words where there are no blanks.
    """
    counts: dict[str, np.ndarray] = {}
    split = [(text, c, _words(text)) for text, c in rows + known]
    for n, (_, c, words) in enumerate(split):
        for w in words:
            counts.setdefault(w, np.full(len(LANGS), 0.1))[c] += 1 if n < len(rows) else 5
    logs = {w: np.log(v / v.sum()) for w, v in counts.items()}
    out = []
    for text, _, words in split[: len(rows)]:
        if not words:
            continue
        votes = np.sum([logs[w] for w in words], 0)
        order = votes.argsort()
        if votes[order[-1]] - votes[order[-2]] > 1:
            out.append((text, int(order[-1])))
    return out


def _words(text: str) -> set[str]:
    wide = "".join(_WIDE.findall(text))
    return {w for w in text.split() if w != "0" and not _WIDE.search(w)} | {wide[k : k + 2] for k in range(len(wide) - 1)}


def _bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c) or ord(c) > 0x3000)


def fit_on(requests: DataFrame, samples: DataFrame, text="text", label="language", key="request_id") -> Network:
    """Trained on the clean samples and at most ``SAMPLE`` whole requests with a label, of up to ``LONGEST_SAMPLE`` characters each."""
    clean = [(r[0], r[1]) for r in sample(samples.where(F.col("lang").isin(*LANGS) & F.col("text").isNotNull()).select("lang", "text"), ["lang", "text"], SAMPLE)]
    named = F.try_element_at(labelled(F.col(label)), F.lit(1))
    rows = requests.where(F.length(text).between(1, LONGEST_SAMPLE)).select(named.alias("lang"), F.col(text).alias("t"), F.col(key).alias("k")).where(F.col("lang").isNotNull())
    return fit(clean, [(r["lang"], r["t"]) for r in sample(rows, ["k", "t"], SAMPLE)])


SEGMENTS = "start_pos int, end_pos int, lang string, confidence double, whole boolean"


def segments(df: DataFrame, network: Network, key: str = "request_id", text: str = "text") -> DataFrame:
    """key, segment_no, start_pos, end_pos, lang, confidence, whole (holds a whole sentence): row-local."""
    weights = network.weights

    def make():
        who = Identifier(Network(weights))

        def work(keys, texts):
            columns: list[list] = [[] for _ in range(7)]
            for k, found in zip(keys, who.segments(texts)):
                for number, (a, b, lang, sure, whole) in enumerate(found, 1):
                    for c, v in zip(columns, (k, number, a, b, lang, round(sure, 4), bool(whole))):
                        c.append(v)
            return columns

        return work

    kind = df.schema[key].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(df.schema[key].dataType), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_()]
    return map_rows(df.select(key, text), make, f"{key} {kind}, segment_no int, {SEGMENTS}", types)


def documents(df: DataFrame, network: Network, key: str = "request_id", text: str = "text") -> DataFrame:
    """key, lang, confidence, n_languages: the language with the most characters, its share of them times its confidence.

    lang is chosen among, and n_languages counts, the languages of whole sentences and of shorter stretches with
    a confidence of CLEAR, or all if there are none; the share is one of all stretches.
    """
    weights = network.weights

    def make():
        who = Identifier(Network(weights))

        def work(keys, texts):
            langs, sures, counts = [], [], []
            for found in who.segments(texts):
                sizes: dict = {}
                for a, b, lang, sure, _ in found:
                    n, s = sizes.get(lang, (0, 0.0))
                    sizes[lang] = (n + b - a, s + sure * (b - a))
                clear = {lang for _, _, lang, sure, whole in found if whole or sure >= CLEAR} or set(sizes)
                best = max(clear, key=lambda x: (sizes[x][0], x), default=None)
                total = sum(n for n, _ in sizes.values())
                langs.append(best)
                sures.append(round(sizes[best][1] / total, 4) if best else 0.0)
                counts.append(len(clear))
            return [keys, langs, sures, counts]

        return work

    kind = df.schema[key].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    return map_rows(df.select(key, text), make, f"{key} {kind}, lang string, confidence double, n_languages int", [to_arrow_type(df.schema[key].dataType), pa.string(), pa.float64(), pa.int32()])
