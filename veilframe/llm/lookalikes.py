"""One consistent form for texts that look the same.

Strings (single characters and short sequences) that are drawn alike form classes: a
union-find joins full and half width forms, ligatures and their letters, composed and
decomposed accents, letters of other scripts with the same shape, kinds of blanks, and
invisible characters with the empty string. Joins are transitive. Each class is
represented by its most frequent member in the corpus (ties: shortest, then lowest code
points), and a text is rewritten by a multi-pattern automaton, longest match first from
the left, until nothing changes.

What can be seen stays apart: case, missing accents, punctuation, digits, line breaks.
Null stays null, empty stays empty; a text of invisible characters alone becomes empty.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.arrow import cut_lineage, map_rows

# Pairs of letters with the same shape, Latin first; upper and lower case stay apart.
SAME_SHAPE = """
A А Α  B В Β  C С Ϲ  E Е Ε  G Ԍ  H Н Η  I І Ι Ӏ  J Ј Ϳ  K К Κ K  M М Μ  N Ν  O О Ο  P Р Ρ  Q Ԛ  S Ѕ  T Т Τ  V Ѵ  W Ԝ  X Х Χ  Y Υ Ү  Z Ζ
a а ɑ  c с ϲ  d ԁ  e е  g ɡ  h һ  i і  j ј ϳ  l ӏ  o о ο  p р  q ԛ  s ѕ  v ѵ ν  w ԝ  x х  y у  u υ ʋ  Å Å  æ ӕ  Æ Ӕ  ə ә  Ə Ә
"""
# Characters without a shape of their own.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯﻿￹￺￻"
REMEMBERED = 100_000  # words kept by a worker before it starts anew
HOT, SALTS, MAX_HOT = 20_000, 64, 10_000  # records of a text that are spread over parts, the parts, and how many such texts there are at most
MAX_FREQUENCIES = sys.maxunicode + 1  # rows of character counts the driver may read: one a code point


class UnionFind:
    """Over strings, with path halving and union by size."""

    def __init__(self):
        self.parent: dict[str, str] = {}
        self.size: dict[str, int] = {}

    def find(self, x: str) -> str:
        parent = self.parent
        if x not in parent:
            parent[x], self.size[x] = x, 1
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            if self.size[a] < self.size[b]:
                a, b = b, a
            self.parent[b] = a
            self.size[a] += self.size[b]

    def classes(self) -> Iterable[list[str]]:
        groups: dict[str, list[str]] = {}
        for x in self.parent:
            groups.setdefault(self.find(x), []).append(x)
        return groups.values()


def _is_invisible(c: str) -> bool:
    n = ord(c)
    return c in INVISIBLE or 0xFE00 <= n <= 0xFE0F or 0xE0000 <= n <= 0xE01EF or unicodedata.category(c) == "Cc" and c not in "\t\n\r\x0b\x0c\x85\x1c\x1d\x1e\x1f"


def _is_blank(c: str) -> bool:
    return unicodedata.category(c) == "Zs" or c == "\t" or c == "⠀" or c == "ㅤ"


def same_look() -> Iterable[tuple[str, str]]:
    """Pairs of strings that look the same, derived from the character database and the fixed shapes."""
    for group in re.split(r"  +|\n", SAME_SHAPE.strip()):
        first, *others = group.split()
        for other in others:
            yield first, other
    for n in range(sys.maxunicode + 1):
        c = chr(n)
        if 0xD800 <= n <= 0xDFFF:
            continue
        if _is_invisible(c):
            yield c, ""
            continue
        if _is_blank(c):
            yield c, " "
            continue
        parts = unicodedata.decomposition(c).split()
        if not parts:
            continue
        kind = parts.pop(0) if parts[0].startswith("<") else ""
        spelled = "".join(chr(int(p, 16)) for p in parts)
        if not kind:
            yield c, unicodedata.normalize("NFD", c)
            if len(spelled) > 1:
                yield c, spelled
        elif kind in ("<wide>", "<narrow>"):
            yield c, spelled
        elif kind in ("<compat>", "<isolated>", "<initial>", "<medial>", "<final>") and len(parts) > 0 and all(unicodedata.category(p)[0] == "L" for p in spelled):
            # joined letter forms and presentation forms, not symbols that abbreviate words
            if 0xFB00 <= n <= 0xFDFF or 0xFE70 <= n <= 0xFEFF or len(spelled) == 2 and unicodedata.category(c)[0] == "L" and n < 0x2000:
                yield c, spelled


def build_classes(frequencies: Mapping[str, int] | None = None) -> dict[str, str]:
    """Every string that is rewritten, with what it becomes.

    ``frequencies`` are counts of code points in the corpus; a sequence counts as its rarest part.
    """
    uf = UnionFind()
    sequences = []
    for a, b in same_look():
        uf.union(a, b)
        sequences += [x for x in (a, b) if len(x) > 1]
    members: dict[str, list[str]] = {}
    for x in list(uf.parent):
        if len(x) == 1:
            members.setdefault(uf.find(x), []).append(x)
    # an accented letter looks the same whichever letter of a class carries the accent
    for x in sequences:
        if unicodedata.combining(x[1]) or x[1] in "゙゚ﾞﾟ":
            for other in members.get(uf.find(x[0]), ()):
                uf.union(x, other + x[1:])
        if len(x) == 3 and unicodedata.combining(x[1]) and unicodedata.combining(x[2]):
            uf.union(x, x[0] + x[2] + x[1]) if unicodedata.combining(x[1]) != unicodedata.combining(x[2]) else None
    count = frequencies or {}

    def rank(x: str):
        return (-min((count.get(c, 0) for c in x), default=0), len(x) > 1 and bool(unicodedata.combining(x[1])), len(x) == 1 and unicodedata.decomposition(x).startswith("<"), len(x), x)

    groups = list(uf.classes())
    single = {}
    for group in groups:
        alone = [x for x in group if len(x) < 2]
        best = "" if "" in group else " " if " " in group else min(alone, key=rank, default=None)
        single.update((x, best) for x in alone)
    out = {}
    for group in groups:
        if "" in group or " " in group:
            best = "" if "" in group else " "
        else:
            # a sequence may stand for its class only if its parts stand for theirs
            stable = [x for x in group if len(x) == 1 or all(single.get(c, c) == c for c in x)]
            best = min(stable or group, key=rank)
        out.update((x, best) for x in group if x != best)
    return out


class Rewriter:
    """Greedy rewriting with an Aho-Corasick automaton."""

    def __init__(self, table: Mapping[str, str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for x, best in table.items():
            self.automaton.add_word(x, (len(x), best))
        self.automaton.make_automaton()
        first = sorted({x[0] for x in table})
        self.touched = re.compile("[" + "".join(map(re.escape, first)) + "]")
        self.ascii_is_plain = not any(x.isascii() for x in table)
        self.seen: dict[str, str] = {}

    def once(self, text: str) -> str:
        out, at = [], 0
        # iter_long gives the longest match at the leftmost place, without overlaps
        for end, (n, best) in self.automaton.iter_long(text):
            start = end - n + 1
            out.append(text[at:start])
            out.append(best)
            at = end + 1
        return "".join(out) + text[at:] if out else text

    def _word(self, word: str) -> str:
        given = word
        # A rewriting can bring a letter and an accent together, so it is repeated until nothing changes. Every
        # round but the last makes the word shorter or brings a symbol nearer to the form that stands for its class;
        # should forms ever lead back to one another, the least of the circle is taken, so the end is the same for all.
        met = {word}
        while (done := self.once(word)) != word:
            word = done
            if word in met:
                circle = [word]
                while (done := self.once(circle[-1])) != word:
                    circle.append(done)
                word = min(circle)
                break
            met.add(word)
        if len(given) <= 40:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[given] = word
        return word

    def __call__(self, text: str | None) -> str | None:
        """No string of the table holds an ordinary blank, so words are rewritten one by one and remembered."""
        if text is None or (self.ascii_is_plain and text.isascii()) or not self.touched.search(text):
            return text
        get, make, plain = self.seen.get, self._word, self.ascii_is_plain
        out = []
        for word in text.split(" "):
            if not (plain and word.isascii()):
                done = get(word)
                word = make(word) if done is None else done
            out.append(word)
        return " ".join(out)


def frequencies(df: DataFrame, text: str = "text") -> dict[str, int]:
    """Counts of the code points of all texts; at most one row a code point reaches the driver.

    Counted per batch in the workers and added up, so nothing but small counters is shuffled.
    """

    def run(batches):
        import numpy as np

        total = np.zeros(sys.maxunicode + 1, np.int64)
        for batch in batches:
            data = "".join(t for t in batch.column(0).to_pylist() if t)
            n = np.bincount(np.frombuffer(data.encode("utf-32-le", "replace"), np.uint32).astype(np.int64))
            total[: len(n)] += n
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(total[codes])], ["code", "n"])

    rows = df.select(text).mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).limit(MAX_FREQUENCIES).collect()
    return {chr(r["code"]): r["n"] for r in rows if not 0xD800 <= r["code"] <= 0xDFFF}


def normalise(df: DataFrame, keys: list[str], text: str = "text", out: str = "same_form", counts: Mapping[str, int] | None = None) -> DataFrame:
    """keys, text and its consistent form."""
    counts = frequencies(df, text) if counts is None else counts
    # The table follows from the character database and the counts, at most one a code point; it is built in each worker.
    sent = df.sparkSession.sparkContext.broadcast({c: n for c, n in counts.items() if len(c) == 1})

    def make():
        rewrite = _rewriter(sent.value)

        def work(*columns):
            return [*columns, [rewrite(t) for t in columns[-1]]]

        return work

    chosen = df.select(*keys, text)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema) + f", {out} string"
    from pyspark.sql.pandas.types import to_arrow_type

    return map_rows(chosen, make, schema, [to_arrow_type(f.dataType) for f in chosen.schema] + [pa.string()])


_made: dict[int, Rewriter] = {}


def _rewriter(counts: Mapping[str, int]) -> Rewriter:
    key = hash(frozenset(counts.items()))
    if key not in _made:
        _made.clear()
        _made[key] = Rewriter(build_classes(counts))
    return _made[key]


def _digests(df: DataFrame, key: str, text: str, counts) -> DataFrame:
    """(k, f, t): key, digest of the form, digest of the text, each once. Null texts have none."""
    rows = normalise(df.where(F.col(text).isNotNull()), [key], text, "f", counts)
    return rows.select(F.col(key).alias("k"), F.unhex(F.md5("f")).alias("f"), F.unhex(F.md5(text)).alias("t")).distinct()


def look_alike_classes(df: DataFrame, key: str = "request_id", text: str = "text", counts: Mapping[str, int] | None = None) -> DataFrame:
    """key, class_id, n_links: one row a record; records with the same class_id look the same.

    ``n_links`` is the number of records of the class whose string is another. The result has as many
    rows as records, whatever the size of the classes; digests are counted before they are joined, so a
    class or text that many records share is one row in each task's share of it. Null texts have no row.
    """
    small = cut_lineage(_digests(df, key, text, counts))
    same = small.groupBy("f", "t").agg(F.count("*").alias("same"))
    whole = same.groupBy("f").agg(F.sum("same").alias("whole"))
    links = same.join(whole, "f").select("f", "t", (F.col("whole") - F.col("same")).alias("n_links"))
    # without links there is nothing to look up, so only records of classes with several strings are joined
    several = links.where("n_links > 0")
    return small.join(several, ["f", "t"], "left").select(F.col("k").alias(key), F.lower(F.hex("f")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def look_alikes(df: DataFrame, key: str = "request_id", text: str = "text", counts: Mapping[str, int] | None = None) -> DataFrame:
    """key_a, key_b: records whose texts differ but look the same, each pair once, smaller key first.

    All pairs, so the result grows with the square of a class; :func:`look_alike_classes` gives the same
    in one row a record. Records reduce to (key, digest of the form, digest of the text) before any shuffle. Only
    digests of forms with two or more different texts go on, distinct texts are paired within a form,
    and keys are attached to the pairs last; so a form that many identical texts
    share costs no pair among them. Records of a text that many records share are spread over ``SALTS``
    parts, to each of which the few pairs of texts are sent. Null texts have no look-alikes.
    """
    small = cut_lineage(_digests(df, key, text, counts))
    variants = small.groupBy("f", "t").agg(F.count("*").alias("n"))
    several = variants.groupBy("f").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where(F.col("lo") != F.col("hi")).select("f")
    kept = variants.join(several, "f", "left_semi").select("f", "t", "n")
    a, b = (kept.select("f", F.col("t").alias(f"t{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    pairs = a.join(b, "f").where("ta < tb").select("ta", "tb", "na", "nb")
    rows = small.select("t", "k", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int").alias("part"))

    def attach(pairs, side):
        """Keys of one side: a hot text's records lie in all parts, any other's in part 0."""
        hot = F.col(f"n{side}") >= least
        spread = pairs.withColumn("part", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        own = rows.join(F.broadcast(hot_texts), "t", "left").select(F.col("t").alias(f"t{side}"), F.col("k").alias(f"k{side}"), F.when(F.col("hot"), F.col("part")).otherwise(0).alias("part"))
        return spread.join(own, [f"t{side}", "part"]).drop("part")

    # Of n records, at most MAX_HOT texts can have n / MAX_HOT records each: so many rows are broadcast at most.
    least = max(HOT, -(-small.count() // MAX_HOT))
    hot_texts = variants.where(F.col("n") >= least).select("t", F.lit(True).alias("hot"))
    both = attach(attach(pairs, "a"), "b").where(F.col("ka") != F.col("kb"))
    return both.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b"))
