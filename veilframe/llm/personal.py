"""Personal information in free text, disguised or plain, with exact places in the source.

A transducer turns a text into the form the detectors read: one width, no invisible
characters, composed accents, one script a word, plain blanks. It keeps, for each
character, where it came from. Two more read that form on: digit words of the ten languages
as digits (two or more side by side, also with figures), at-signs and dots as words or in
brackets as signs. Detectors work on these forms and their spans are mapped back to the source.

Numbers are found at their digits: what stands around a run of digits is matched against
the shapes of telephone numbers, identity numbers and, with the words beside it, street
addresses. Names are sequences of given names, surnames and initials; which words are
names is learned from all that an older detector reported, a word counting as a name only
if enough of the spans with it are names. Words of
introduction and labels also make a capitalised sequence a name.

Null and empty texts have no spans. Spans do not overlap: the longer wins, then the earlier.
Repeated rows count once.
"""

from __future__ import annotations

import atexit
import re
import shutil
import sqlite3
import tempfile
import unicodedata
import uuid
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.arrow import map_rows
from veilframe.llm.lookalikes import INVISIBLE, SAME_SHAPE

LEAST_SEEN, LEAST_SHARE, LEAST_WHOLE = 3, 0.3, 5  # of a name word among names, of its spans; of a Chinese name with an unknown surname

# ---- transducers ----

_GONE = set(INVISIBLE)
_GROUPS = [g.split() for g in re.split(r"  +|\n", SAME_SHAPE.strip())]
_TO_LATIN = {o: g[0] for g in _GROUPS for o in g[1:]}
_TO_CYRILLIC = {}
for _g in _GROUPS:
    if _own := [c for c in _g if "Ѐ" <= c <= "џ"]:
        _TO_CYRILLIC.update((c, _own[0]) for c in _g if c != _own[0] and not "Ѐ" <= c <= "џ")
_LATIN_ONLY = re.compile("[" + "".join(c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" if c not in {g[0] for g in _GROUPS}) + "]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_CYRILLIC_ONLY = re.compile("[" + "".join(c for c in map(chr, range(0x400, 0x460)) if c not in _TO_LATIN) + "]")
_MIXED = re.compile(r"[A-Za-z][Ͱ-ԯ]|[Ͱ-ԯ][A-Za-z]|[Ͱ-Ͽ]")
_SPECIAL = re.compile("[" + "".join(map(re.escape, sorted(_GONE))) + "︀-️   -   　\t！-｠ｦ-￦ﬀ-ﬆ̀-゙゚ͯKÅ]")
_WORDS = re.compile(r"[^\W\d_]+")


def _form(c: str) -> str:
    """A character as the detectors read it; empty if it cannot be seen."""
    if c in _GONE or "︀" <= c <= "️":
        return ""
    if c == "\t" or unicodedata.category(c) == "Zs":
        return " "
    return unicodedata.normalize("NFKC", c) if _SPECIAL.match(c) else c


class _Even(dict):
    """Forms of single characters, computed when they are met."""

    def __missing__(self, code: int) -> str:
        self[code] = got = _form(chr(code))
        return got


_EVEN = _Even()
_UNEVEN = re.compile("[" + "".join(map(re.escape, sorted(_GONE))) + "︀-️ﬀ-ﬆ̀-゙゚ͯｦ-ﾟ]")


class Source:
    """A text in the form the detectors read, with the way back; ``first`` is None if nothing changed."""

    __slots__ = ("text", "first", "after")

    def __init__(self, given: str):
        self.text, self.first, self.after = given, None, None
        if given.isascii():
            if "\t" in given:
                self.text = given.replace("\t", " ")
            return
        if _SPECIAL.search(given):
            if not _UNEVEN.search(given):
                self.text = _SPECIAL.sub(lambda m: _EVEN[ord(m.group())], given)
            else:
                self._map(given)
        if _MIXED.search(self.text):
            self.text = one_script(self.text)

    def _map(self, given: str) -> None:
        out: list[str] = []
        first: list[int] = []
        after: list[int] = []
        at = 0
        for m in _SPECIAL.finditer(given):
            i, c = m.start(), m.group()
            if at < i:
                out += given[at:i]
                first += range(at, i)
                after += range(at + 1, i + 1)
            at = i + 1
            if c >= "\u0300" and out and unicodedata.combining(c):
                joined = unicodedata.normalize("NFC", out[-1] + c)
                if len(joined) == 1:
                    out[-1], after[-1] = joined, i + 1
                    continue
            for f in _EVEN[ord(c)]:
                out.append(f)
                first.append(i)
                after.append(i + 1)
        out += given[at:]
        first += range(at, len(given))
        after += range(at + 1, len(given) + 1)
        self.text, self.first, self.after = "".join(out), first, after

    def back(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.first is None else (self.first[start], self.after[end - 1])


def one_script(text: str) -> str:
    """Letters that only look like those of their word's script become letters of that script; lengths stay."""
    latin_text = len(_LATIN_ONLY.findall(text)) >= len(_CYRILLIC_ONLY.findall(text))

    def word(m):
        w = m.group()
        if w.isascii():
            if latin_text or _LATIN_ONLY.search(w):
                return w
        if _LATIN_ONLY.search(w):
            return "".join(_TO_LATIN.get(c, c) for c in w)
        if _CYRILLIC_ONLY.search(w):
            return "".join(_TO_CYRILLIC.get(c, c) for c in w)
        table = _TO_LATIN if latin_text else _TO_CYRILLIC
        return "".join(table.get(c, c) for c in w)

    return _WORDS.sub(word, text)


class Reading:
    """A text with some stretches written otherwise, with the way back to the text."""

    def __init__(self, text: str, changes: list[tuple[int, int, str]]):
        """changes: (start, end, new text), in order; all of the new text stands for all of the stretch."""
        out: list[str] = []
        first: list[int] = []
        after: list[int] = []
        at = 0
        for start, end, new in changes:
            out += (text[at:start], new)
            first += range(at, start)
            after += range(at + 1, start + 1)
            first += [start] * len(new)
            after += [end] * len(new)
            at = end
        out.append(text[at:])
        first += range(at, len(text))
        after += range(at + 1, len(text) + 1)
        self.text, self.first, self.after = "".join(out), first, after

    def back(self, start: int, end: int) -> tuple[int, int]:
        return self.first[start], self.after[end - 1]


# Digits as words, by language (en de fr es it pt nl ru zh ja), from 0 on; other words of one digit follow a slash.
_DIGIT_WORDS = """
zero/oh/nought one two three four five six seven eight nine
null eins/ein zwei/zwo drei vier fünf/fuenf sechs sieben acht neun
zéro/zero un/une deux trois quatre cinq six sept huit neuf
cero uno/una dos tres cuatro cinco seis siete ocho nueve
zero uno due tre quattro cinque sei sette otto nove
zero um/uma dois/duas três/tres quatro cinco seis/meia sete oito nove
nul een/één twee drie vier vijf zes zeven acht negen
ноль/нуль один/одна два/две три четыре пять шесть семь восемь девять
零/〇/○ 一/幺/壹 二/两/贰 三/叁 四/肆 五/伍 六/陆 七/柒 八/捌 九/玖
ゼロ/れい/まる いち/イチ に/ニ さん/サン よん/ヨン ご/ゴ ろく/ロク なな/ナナ/しち はち/ハチ きゅう/キュウ
"""
_VALUES = {w: str(n) for line in _DIGIT_WORDS.strip().split("\n") for n, words in enumerate(line.split()) for w in words.split("/")}
_TIMES = {"double": 2, "doppel": 2, "dubbel": 2, "doble": 2, "doppio": 2, "triple": 3, "triplo": 3, "tripel": 3}
_any = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))
_SPACED, _JOINED = _any(w for w in _VALUES if w < "\u3000"), _any(w for w in _VALUES if w >= "\u3000")
_DIGIT = rf"(?:(?:(?:{_any(_TIMES)})[ -])?(?<!\w)(?:{_SPACED})(?!\w)|(?:{_JOINED}))"
_BETWEEN = r"(?: ?[,;./、，‐-―-] ?| {1,2})"
_ONE_DIGIT = re.compile(rf"(?P<times>(?:{_any(_TIMES)})[ -])?(?P<word>{_SPACED}|{_JOINED})|(?P<plus>plus|más|più|плюс|プラス)|(?P<figures>[0-9]+)|(?P<rest>.)", re.I | re.S)
# A digit word and what follows of digit words and figures; figures before it are looked up from there.
_SPELLED_RUN = re.compile(rf"{_DIGIT}(?:{_BETWEEN}?(?:{_DIGIT}|(?<![A-Za-zÀ-ӿ])[0-9]+(?![A-Za-zÀ-ӿ])))*", re.I)
_BEFORE_RUN = re.compile(rf"(?:(?:(?<!\w)(?:plus|más|più|плюс) |プラス)|(?<![A-Za-z0-9À-ӿ.,-])\+?[0-9]+{_BETWEEN}?(?:[0-9]+{_BETWEEN}?)*)$", re.I)
_SPOKEN = {w for w in _VALUES if w < "\u3000"} | set(_TIMES)
_PARTS = re.compile(r"[^\W\d_]+|[0-9]+")
_JOINED_PAIR = re.compile(rf"(?:{_JOINED}){_BETWEEN}?(?:{_JOINED}|[0-9]+{_BETWEEN}?(?:{_JOINED}))")


def _is_spoken(text: str, low: str) -> bool:
    """Whether two digit words stand side by side or with only figures between."""
    n = 0
    for part in _PARTS.findall(low):
        if part in _SPOKEN:
            n += 1
            if n > 1:
                return True
        elif not part.isdigit():
            n = 0
    return not text.isascii() and bool(_JOINED_PAIR.search(text))


_KANA = re.compile("[ぁ-ヿ]")
_ID_LETTERS = re.compile(r"(?<![\w-])(?:[A-Z]{2}|[A-Z] [A-Z]|[A-Z])[ -]$"), re.compile(r"[ -]?[A-Z](?!\w)")


def _spelled(text: str, low: str) -> list[tuple[int, int, str]]:
    """Numbers with digits as words: what the detectors find where the words are figures."""
    if not _is_spoken(text, low):
        return []
    changes: list[tuple[int, int, str]] = []
    runs: list[tuple[int, int, int, int, bool]] = []  # start, end, digit words, digits, whether the run has figures
    done = 0
    for m in _SPELLED_RUN.finditer(text):
        lead = _BEFORE_RUN.search(text, max(done, m.start() - 40), m.start())
        begin, done = lead.start() if lead else m.start(), m.end()
        told = [(p.lastgroup, p) for p in _ONE_DIGIT.finditer(text, begin, m.end()) if p.lastgroup != "rest"]
        n_words, n_digits, figures, own = 0, 0, False, []
        for i, (kind, p) in enumerate(told):
            if kind == "word":
                new = _VALUES[p["word"].lower()] * (_TIMES[p["times"][:-1].lower()] if p["times"] else 1)
                n_words += 1
            elif kind == "plus":
                after = told[i + 1][1] if i + 1 < len(told) else None
                new = "+" if after is not None and (after.group()[0] if after["figures"] else _VALUES.get((after["word"] or "").lower())) != "0" else None
            else:
                new, figures = p.group(), True
            n_digits += len(new or "") if kind != "plus" else 0
            end = p.end()
            # what is between two digit words or after a plus goes; else the number keeps its groups
            if i + 1 < len(told):
                follows = told[i + 1]
                if new is not None:
                    own.append((p.start(), end, new))
                    gap = follows[1].start() > end
                    if gap and (kind == "plus" or kind == follows[0] == "word"):
                        own.append((end, follows[1].start(), ""))
            elif new is not None:
                own.append((p.start(), end, new))
        if n_words < 2 or (n_digits < 7 and _KANA.search(text, *m.span())):
            continue
        start = begin if told[0][0] != "plus" or own[0][2] == "+" else told[1][1].start()
        changes += own
        runs.append((start, m.end(), n_words, n_digits, figures))
    if not runs:
        return []
    form, out, k = Reading(text, changes), [], 0
    starts = form.first
    for start, end, n_words, n_digits, figures in runs:
        while k < len(starts) and starts[k] < start:
            k += 1
        stop = k
        while stop < len(starts) and starts[stop] < end:
            stop += 1
        hits = []
        for d in _DIGITS.finditer(form.text, k, stop):
            if hits and d.start() < hits[-1][1]:
                continue
            if hit := _number(form.text, d.start(), d.end()):
                hits.append(hit)
        found = [(*form.back(a, b), kind) for a, b, kind in hits]
        if not any(a <= start and end <= b for a, b, _ in found):
            number = re.sub(r"[^0-9+]", "", form.text[k:stop])
            head, tail = _ID_LETTERS[0].search(text, max(0, start - 4), start), _ID_LETTERS[1].match(text, end)
            for h, t in ((head, tail), (head, None), (None, tail)):
                whole = re.sub("[ -]", "", (h.group() if h else "") + number + (t.group() if t else ""))
                if (h or t) and _ID.fullmatch(whole):
                    found = [(h.start() if h else start, t.end() if t else end, "ID_NUMBER")]
                    break
            else:
                # a spelled number of another shape is a telephone number
                if (9 <= n_digits <= 15 if figures else 7 <= n_digits <= 19) and n_words >= 3 and not _OTHER.search(text, max(0, start - 12), start):
                    found = [(start, end, "PHONE_NUMBER")]
        out += found
    return out


# At-signs and dots as words, by language. Bare words count between blanks; a bare "point" is also
# English and needs an at-sign that is no English word.
_AT_NAMES = r"at|ät|arroba|arobase|arobas|arrobase|chiocciola|apenstaartje|klammeraffe|собака|эт|艾特|アットマーク|アット"
_DOT_NAMES = r"dot|punkt|point|punto|ponto|punt|точка|点|點|ドット"
_DOMAIN = rf"[A-Za-z0-9-]+(?:\.[A-Za-z0-9]| ?[(\[{{<] ?(?:{_DOT_NAMES}|\.)| ?(?:点|點|ドット)| (?:{_DOT_NAMES}) )"  # as far as its first dot
_SIGN = re.compile(
    rf"(?P<at> ?[(\[{{<] ?(?:{_AT_NAMES}|@) ?[)\]}}>] ?| @ ?|@ | ?(?:艾特|アットマーク|アット) ?| (?:{_AT_NAMES}) (?={_DOMAIN}))"
    rf"|(?P<dot> ?[(\[{{<] ?(?:{_DOT_NAMES}|\.) ?[)\]}}>] ?| ?(?:点|點|ドット) ?| (?:{_DOT_NAMES}) )",
    re.I,
)
_AT_THERE = re.compile(rf"@|[(\[{{<] ?(?:{_AT_NAMES}) ?[)\]}}>]|艾特|アット| (?:{_AT_NAMES}) (?={_DOMAIN})", re.I)
_MORE = re.compile("[A-Za-z0-9._%+-]*@")


def _mail_at(text: str, at: int, done: int) -> re.Match | None:
    """The address around an at-sign; its local part begins where the run of local characters does, whatever its length."""
    start = at
    while start > done and text[start - 1] in _LOCAL:
        start -= 1
    return _PLAIN_MAIL.match(text, start) if start < at else None


def _disguised(text: str) -> list[tuple[int, int, str]]:
    """E-mail addresses whose signs are disguised, by the plain pattern where the signs are signs."""
    if not _AT_THERE.search(text) or not (signs := list(_SIGN.finditer(text))):
        return []
    changes, told = [], {}
    for m in signs:
        changes.append((m.start(), m.end(), "@" if m["at"] else "."))
        told[m.start()] = m.group().strip().lower()
    form, out, done = Reading(text, changes), [], 0
    for sign in re.finditer("@", form.text):
        at = sign.start()
        if at < done:
            continue
        m = _mail_at(form.text, at, done)
        if m is None:
            continue
        said = told.get(form.first[at], "@")
        if said == "at":
            # a plain "at" is a word of the sentence if another sign follows; else the domain's dots are words too, or what stands before is no common word
            dots = [told[form.first[p]] for p in range(at + 1, m.end()) if form.first[p] in told]
            local = form.text[m.start() : at]
            if _MORE.match(form.text, m.end()) or not (any(d != "point" for d in dots) or (re.search("[A-Za-z]", local) and re.search("[._%+0-9]", local))):
                done = at + 1
                continue
        done = m.end()
        if any(form.first[p] in told for p in range(*m.span())):
            out.append((*form.back(*m.span()), "EMAIL_ADDRESS"))
    return out


# ---- detectors ----

_E = r"[A-Za-z0-9]"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_PLAIN_MAIL = re.compile(rf"(?<![A-Za-z0-9._%+-]){_E}[A-Za-z0-9._%+-]*@{_E}[A-Za-z0-9-]*(?:\.{_E}[A-Za-z0-9-]*)+")

_DIGITS = re.compile(r"[0-9]+")
_BEFORE = re.compile(r"(?:[A-Z]{1,2} ?|[XYZ]-|(?<![A-Za-z])[A-Z]{6})$")
# Shapes of telephone numbers, read from the first character on.
_PHONE = re.compile(
    r"(?:\+[0-9]{1,3}(?:[ -]?\(0\))?(?:[ .-]?\(?[0-9]{1,8}\)?){1,5}"
    r"|00[1-9][0-9]{0,2}(?:[ -][0-9]{2,6}){2,4}"
    r"|\([0-9]{3,5}\) ?[0-9]{3,5}[ -]?[0-9]{3,5}"
    r"|1 [2-9][0-9]{2} [0-9]{3} [0-9]{4}"
    r"|(?:1[.-])?[2-9][0-9]{2}([.-])[0-9]{3}\1[0-9]{4}"
    r"|0[0-9]{4} [0-9]{6}|0[0-9]{2,3} [0-9]{3,4} [0-9]{4}"
    r"|0[0-9]{2,4}/[0-9]{5,9}"
    r"|0[1-9](?:([ .])[0-9]{2})(?:\2[0-9]{2}){3}"
    r"|0[0-9]{9}(?![0-9])|[2-9][0-9]{2}[2-9][0-9]{6}(?![0-9])"
    r"|1[3-9][0-9]{9}(?![0-9])|1[3-9][0-9]([ -])[0-9]{4}\3[0-9]{4}"
    r"|0[0-9]{2,3}-[0-9]{7,8}|0[0-9]{1,3}-[0-9]{2,4}-[0-9]{4}"
    r"|[6-9][0-9]{2} [0-9]{2} [0-9]{2} [0-9]{2})(?![0-9]|[.,:-][0-9]|[A-Za-z])"
)
# Shapes of identity numbers.
_ID = re.compile(
    r"(?:[0-9]{3}([ -])[0-9]{2}\1[0-9]{4}"
    r"|[A-Z]{2}( ?)[0-9]{2}\2[0-9]{2}\2[0-9]{2}\2[A-D]"
    r"|[A-Z][0-9]{8,9}|[CFGHJKLMNPRTVWXYZ][0-9]{2}[0-9CFGHJKLMNPRTVWXYZ][0-9CFGHJKLMNPRTVWXYZ][0-9]{4,5}|[0-9]{2} [0-9]{6} [A-Z] [0-9]{3}"
    r"|[0-9]{8}-?[A-Z]|[XYZ](-?)[0-9]{7}\3[A-Z]"
    r"|[12] [0-9]{2} [0-9]{2} [0-9]{2} [0-9]{3} [0-9]{3} [0-9]{2}|[12][0-9]{14}"
    r"|[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]"
    r"|[0-9]{8} [0-9] [A-Z]{2}[0-9]|[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}"
    r"|[0-9]{3}-[0-9]{3}-[0-9]{3} [0-9]{2}|[0-9]{4} [0-9]{6}"
    r"|[0-9]{17}[0-9XxΧХх]|[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{12}|[0-9]{9})(?![0-9A-Za-z]|[.,:-][0-9])"
)
# What, right before a number, makes it something else.
_OTHER = re.compile(r"(?:\b(?:order|lot|sn|isbn|inv|trk|rev|version|v|ref|ticket|batch|item|serial|invoice|tracking)[ .:#_/-]*|[#@_/]|[A-Za-z0-9]-|[0-9][.,:])$", re.I)

_C = "A-ZÀ-ÖØ-ÞŁŚŠŽА-ЯЁ"
_W = rf"[{_C}][\w’'-]*"
# Words that end a town even where everything is in capitals.
_NOT_TOWN = r"(?!(?:TO|AND|THE|LAST|TOOK|IS|WAS|WHILE|FOR|APT|FLAT|BELL|UND|AUF|ET|LE|LA|EN|EL|Y|E|SUL|NA|OP|DE|DER|I|A|ON|IN|IF|BY|AT)\b)"
_LINK = r"(?:d[eio]|del|della|das|dos|da|las|los|la|le|les|sur|sous|am|an|der|aan|den|upon|on)"
_TOWN = rf"(?:(?:Las|Los|La|Le|Les|El|Den|LAS|LES)[ -])?{_NOT_TOWN}{_W}(?:(?: {_LINK}| {_LINK.upper()}){{1,2}} {_W}| {_NOT_TOWN}{_W}){{0,2}}"
_UNIT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)"
_UNIT_BEFORE = re.compile(rf"(?i:{_UNIT}) $")
_STREET_EN = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Way|Drive|Dr|Close|Place|Square|Sq|Terrace|Boulevard|Blvd|Row|Gardens|Crescent|Walk|Grove)"
_OF = r"(?:de la |de las |de los |de l['’]|des |del |della |delle |dello |dei |degli |du |das |dos |da |do |de |di |d['’])"
_NAMED = rf"(?i:{_OF})?{_W}(?: (?:(?i:{_OF}))?{_W}){{0,3}}"
_EN = re.compile(
    rf"(?:(?i:{_UNIT}) [0-9]+[A-Za-z]?, )?[0-9]{{1,5}}[A-Za-z]? (?:{_W} ){{1,4}}?(?i:{_STREET_EN})\b(?:\.(?=,))?(?:, (?i:{_UNIT}) [0-9]+[A-Za-z]?)?(?:, {_TOWN}(?: [0-9]{{5}}(?:-[0-9]{{4}})?| [A-Z]{{1,2}}[0-9][0-9A-Z]? [0-9][A-Z]{{2}})?\b)?"
)
_FR = re.compile(
    rf"[0-9]{{1,4}}(?: (?i:bis|ter|quater))?,? (?i:rue|avenue|av\.|bd|boulevard|place|chemin|impasse|allée|allee|quai|cours|route|square|passage|ruelle) {_NAMED}(?:, (?:[0-9]{{5}} )?{_TOWN})?"
)
# Streets that stand before their number: (street right before the number, what follows the number's first digit).
_BEFORE_NUMBER = re.compile(
    rf"(?:(?i:\bcalle|\bc/|\bavenida|\bavda\.?|\bplaza|\bpaseo|\btraves[ií]a|\bcamino|\bcarretera|\bronda|\bvia|\bviale|\bpiazza|\bpiazzale|\bvicolo|\bcorso|\blargo|\bstrada|\brua|\btravessa|\bpraça|\bpraca|\balameda|\bestrada|\bav\.) {_NAMED}"
    rf"|(?<!\w)(?:(?:Lange|Korte|Oude|Nieuwe|Grote|Kleine|Hoge|LANGE|OUDE|NIEUWE) )?[{_C}][\w-]*(?i:straße|strasse|str\.|gasse|allee|weg|platz|ring|damm|ufer|straat|laan|kade|plein|gracht|singel|dijk|dreef|steeg)"
    rf"|(?<!\w)(?:Am|An der|An den|Auf der|Auf dem|Im|Zum|Zur|Unter den|AM|AN DER|IM|ZUM|ZUR) {_W}(?: {_W})?"
    rf"|(?i:\bул\.|\bулица|\bпр\.|\bпросп\.|\bпроспект|\bпер\.|\bпереулок|\bбульвар|\bшоссе|\bнаб\.|\bнабережная|\bплощадь) {_W}(?: {_W})?,? (?i:д\.|дом)"
    rf"|(?<!\w){_W} (?i:улица|проспект|переулок|бульвар|шоссе|набережная|площадь),? (?i:д\.|дом))(?:,| (?i:n\.?º|no\.?|nr\.?))? ?$"
)
_AFTER_NUMBER = re.compile(
    rf"[0-9]{{1,4}}(?:(?: ?[a-z]|[A-Z]|-[A-Za-z])(?!\w))?(?:/[0-9A-Za-z]{{1,3}})?(?:,? (?i:корп\.|к\.|стр\.) ?[0-9]+)?(?:, (?i:кв\.|квартира) ?[0-9]+)?(?:, [0-9]{{1,2}}\.?º(?: [A-Za-z]{{1,4}}\b)?)?"
    rf"(?:, (?:(?:[0-9]{{5}}|[0-9]{{4}}-[0-9]{{3}}|[0-9]{{4}} ?[A-Z]{{2}}) )?{_TOWN})?"
)
_LEADING = re.compile(rf"(?:[0-9]{{6}}, )?(?:(?i:г\.|город) ?{_W}, )$")
_ZH = re.compile(r"([一-鿿]{1,24}(?:路|街|巷|道|弄|胡同|里|村))$")
_ZH_AFTER = re.compile(r"[0-9]{1,5}号(?:[0-9一二三四五六七八九十]{1,4}(?:栋|幢|座|号楼|楼|单元|层))*(?:[0-9]{1,5}(?:室|房|号))?")
_ZH_CUT = re.compile("[在到址是于从往至寄给把向住为叫去达]")
_JA = re.compile(r"(?:〒?[0-9]{3}-[0-9]{4} ?)?([一-鿿々ノヶケ]{2,12})$")
_JA_AFTER = re.compile(r"[0-9]{1,3}(?:丁目[0-9]{1,3}(?:番地?|-)[0-9]{1,3}号?|-[0-9]{1,3}-[0-9]{1,3})(?![0-9]|-[0-9])(?:[ 　]?[ァ-ヴー一-鿿]{2,12}[0-9]{1,4}号室|[ 　]?[0-9]{1,4}号室)?")

_CAPITAL = re.compile(rf"(?<![\w’'-])[{_C}][\w]*(?:['’-][\w]+)*")
_GAP = re.compile(r"(\.?,? ?)(?:((?:von|van|de|del|da|di|dos|der|den|ter|la|le|zu|VON|VAN|DE|DEL|DA|DER|DEN) (?:(?:der|den|la|DER|DEN|LA) )?))?")
_NAME_SHAPE = re.compile("GI*P?S|SCGI*|SCI+|I+P?S|SGI*|SI+(?!S)")
# What introduces a name, and labels of names.
_INTRODUCED = re.compile(
    rf"(?:(?i:\bmy name is|\bje m['’]appelle|\bmein name ist|\bme llamo|\bmi chiamo|\bo meu nome é|\bo meu nome e|\bmijn naam is|\bменя зовут|\bi am called)|(?i:\b(?:full name|name|nom|nombre|nome|naam|имя|фио)\"?[:=] ?\"?)) ?((?:{_W}|[{_C}]\.)(?:,? (?:{_W}|[{_C}]\.|von|van|de|del|da)){{1,3}})"
)
_INTRODUCERS = ("name", "appelle", "nom", "llamo", "chiamo", "naam", "зовут", "имя", "фио", "i am called")
_HAN = re.compile("[一-鿿]")
_INTRODUCED_CJK = re.compile(r"(?:我叫|姓名[\"”]?[:：=] ?[\"“]?)([一-鿿]{2,4})(?=[，。,;；\s\"”)）]|$)|(?:氏名[\"”]?[:：=] ?[\"“]?|私の名前は)([一-鿿々ノヶ]{3,7})(?=[で、。,;\s\"”]|$)")


def _fold(word: str) -> str:
    word = word.casefold()
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


class Words(Mapping):
    """Words and their roles in a file that Spark hands to every executor. They are sought on disk: memory does not limit their number."""

    def __init__(self, name: str):
        self.name, self.db = name, None

    def __reduce__(self):
        return Words, (self.name,)

    def _rows(self, sql: str, *values):
        if self.db is None:
            self.db = sqlite3.connect(Path(SparkFiles.get(self.name)).absolute().as_uri() + "?mode=ro&immutable=1", uri=True, check_same_thread=False)
        return self.db.execute(sql, values)

    def get(self, word, default=None):
        got = self._rows("SELECT roles FROM words WHERE word = ?", word).fetchone()
        return got[0] if got else default

    def __getitem__(self, word):
        if (got := self.get(word)) is None:
            raise KeyError(word)
        return got

    def __iter__(self):
        return (w for (w,) in self._rows("SELECT word FROM words"))

    def __len__(self):
        return self._rows("SELECT count(*) FROM words").fetchone()[0]


class Lexicon:
    """Roles of words in names: G given, S surname; of Chinese and Japanese names s surname, g given, w whole. ``firsts``: what the latter begin with."""

    def __init__(self, roles: Mapping[str, str], firsts: str = ""):
        self.roles, self.firsts = roles, firsts
        self.han = re.compile(f"[{firsts}]") if firsts else None
        self.roles_of: dict[str, str] = {}
        self.han_roles_of: dict[str, str] = {}

    def role(self, word: str) -> str:
        got = self.roles_of.get(word)
        if got is None:
            if len(self.roles_of) > 100_000:
                self.roles_of.clear()
            got = self.roles.get(_fold(word), "")[:1]
            got = self.roles_of[word] = got if got in "GS" else ""
        return got

    def han_roles(self, word: str) -> str:
        got = self.han_roles_of.get(word)
        if got is None:
            if len(self.han_roles_of) > 100_000:
                self.han_roles_of.clear()
            got = self.han_roles_of[word] = self.roles.get(word, "")
        return got

    def han_names(self, text: str) -> Iterator[tuple[int, int]]:
        """Places of Chinese and Japanese names: surname and given name before whole ones, the longer before the shorter."""
        at = 0
        while m := self.han and self.han.search(text, at):
            start, whole = m.start(), 0
            at = start + 1
            for n in range(5, 0, -1):
                end = start + n + 2
                if "g" in self.han_roles(text[start + n : end]):
                    if "s" in self.han_roles(text[start : start + n]):
                        at = end
                        break
                    if not whole and "w" in self.han_roles(text[start:end]):
                        whole = end
            else:
                at = whole or at
            if at > start + 1:
                yield start, at


def word_counts(text: str, kind: str | None, n: int = 1) -> list[tuple[str, bool, int, int, int, int]]:
    """(word, whether a whole Han name, seen, in a name, first in a name, last in a name) of a span reported ``n`` times."""
    text = Source(text).text.strip()
    name = (kind or "").upper() in ("USER_NAME", "PER", "PERSON", "NAME")
    if _HAN.search(text):
        return [(text, True, n, n, 0, 0)] if name and re.fullmatch(r"[一-鿿々ノヶ]{3,7}", text) else []
    words = [_fold(w) for w in re.findall(r"[^\W\d_]{2,}(?:['’-][^\W\d_]+)*", text)]
    out = [(w, False, n, 0, 0, 0) for w in set(words)] if "@" not in text and " dot " not in text else []
    if name and 1 <= len(words) <= 4:
        out += [(w, False, 0, n, 0, 0) for w in set(words)]
        full = [_fold(w) for w in re.findall(rf"(?<![\w’'-])[{_C}][\w]+(?:['’-][\w]+)*", text)]
        if len(full) == 2:
            a, b = full[::-1] if "," in text else full
            out += [(a, False, 0, 0, n, 0), (b, False, 0, 0, 0, n)]
    return out


def is_name_word(seen, named, first, last):
    """The test a word must pass, for numbers and columns alike."""
    return (named >= LEAST_SEEN) & (named >= LEAST_SHARE * seen) & (first + last >= 2)


def lexicon_of(counted) -> Lexicon:
    """From words that passed the test and whole Han names, as (word, han, seen, named, first, last)."""
    roles = {w: "G" if first > last else "S" for w, han, _, _, first, last in counted if not han}
    names = {w: named for w, han, _, named, _, _ in counted if han}
    heads, tails = {}, {}
    for text in names:
        heads.setdefault(text[:-2], set()).add(text[-2:])
        tails.setdefault(text[-2:], set()).add(text[:-2])
    surnames = {h for h, t in heads.items() if len([x for x in t if len(tails[x]) >= 2]) >= 2}
    givens = {t for t, h in tails.items() if len(h & surnames) >= 2}
    whole = {t for t, n in names.items() if n >= LEAST_WHOLE and not (t[:-2] in surnames and t[-2:] in givens) and len(t) <= 5 and t[-2:] in givens}
    for role, words in zip("gsw", (givens, surnames, whole)):
        for w in words:
            roles[w] = roles.get(w, "") + role
    return Lexicon(roles, "".join({w[0] for w in surnames | whole}))


def learn(spans: list[tuple[str, str]]) -> Lexicon:
    """The lexicon of a few spans (reported text, reported type), without a session."""
    total: dict[tuple, list] = {}
    for text, kind in spans:
        for word, han, *more in word_counts(text, kind):
            at = total.setdefault((word, han), [0, 0, 0, 0])
            at[:] = map(sum, zip(at, more))
    return lexicon_of([(w, han, *c) for (w, han), c in total.items() if han or is_name_word(*c)])


def find(given: str | None, lexicon: Lexicon) -> list[tuple[int, int, str]]:
    """(start, end, type) of the personal information of a text, in source positions, by start."""
    if not given:
        return []
    source = Source(given)
    text = source.text
    found: list[tuple[int, int, str]] = []
    low = text.lower()
    done, at = 0, text.find("@")
    while at >= 0:
        if at >= done and (hit := _mail_at(text, at, done)):
            found.append((*hit.span(), "EMAIL_ADDRESS"))
            done = hit.end()
        at = text.find("@", at + 1)
    found += _disguised(text)
    skip = sorted((a, b) for a, b, _ in found)
    done, k = 0, 0
    for m in _DIGITS.finditer(text):
        at = m.start()
        if at < done:
            continue
        while k < len(skip) and skip[k][1] <= at:
            k += 1
        if k < len(skip) and skip[k][0] <= at:
            continue
        if hit := _number(text, at, m.end()):
            found.append(hit)
            done = hit[1]
    found += _spelled(text, low)
    found += _names(text, low, lexicon)
    if not found:
        return []
    taken: list[tuple[int, int, str]] = []  # by start, so that only the two neighbours can overlap
    for f in sorted(found, key=lambda f: (f[0] - f[1], f[0], f[2])):
        i = bisect_left(taken, f)
        if (i == 0 or taken[i - 1][1] <= f[0]) and (i == len(taken) or f[1] <= taken[i][0]):
            taken.insert(i, f)
    return [(*source.back(a, b), kind) for a, b, kind in taken]


def _number(text: str, at: int, end: int) -> tuple[int, int, str] | None:
    """What the digits at ``at`` belong to."""
    start, last = at, text[at - 1] if at else " "
    if last in "+(":
        start = at - 1
    elif last.isupper() or (last in " -" and text[at - 2 : at - 1].isupper()):
        if m := _BEFORE.search(text, max(0, at - 8), at):
            start = m.start()
    n = end - at
    # addresses first: their numbers are short
    if n <= 5 and last not in "+(-./" and (hit := _address(text, at)):
        return (*hit, "PHYSICAL_ADDRESS")
    if start != at and text[start].isalpha():
        starts = (start, at) if start == at - 1 or text[at - 1] in " -" else (start, start + 1, at)
    else:
        starts = (start,)
    for s in starts:
        before = text[s - 1] if s else " "
        if before.isascii() and (before.isalnum() or before in ".-/#_@+:" and (s > 1 and (text[s - 2].isalnum() and before != ":") or before in "#_@")):
            continue
        a, b = _ID.match(text, s), _PHONE.match(text, s)
        if b and not 9 <= sum(c.isdigit() for c in b.group()) <= 15:
            b = None
        if not a and not b:
            continue
        if _OTHER.search(text, max(0, s - 12), s):
            return None
        best = b if b and (not a or b.end() > a.end() or (b.end() == a.end() and text[s] in "+(0" and a.end() - s != 14)) else a
        return (s, best.end(), "PHONE_NUMBER" if best is b else "ID_NUMBER")
    return None


def _after_street(lead: str) -> bool:
    """Whether the word before a number can end the name of a street."""
    word = lead.rstrip(" ,").rsplit(" ", 1)[-1].rsplit("=", 1)[-1].rsplit('"', 1)[-1]
    return word[:1].isupper() or word in ("дом", "д.") or word.lower() in ("nº", "n.º", "no", "nr.")


def _address(text: str, at: int) -> tuple[int, int] | None:
    last = text[at - 1] if at else " "
    if last.isascii():
        if last not in " \n\r\t,(\"'=:>;|[{":
            return None
        unit = _UNIT_BEFORE.search(text, max(0, at - 11), at) if last == " " else None
        if m := (unit and _EN.match(text, unit.start())) or _EN.match(text, at) or _FR.match(text, at):
            return m.span()
        if last in " ," and _after_street(text[max(0, at - 40) : at]) and (m := _BEFORE_NUMBER.search(text, max(0, at - 90), at)) and (n := _AFTER_NUMBER.match(text, at)):
            town = _LEADING.search(text, max(0, m.start() - 40), m.start())
            return town.start() if town else m.start(), n.end()
        return None
    if m := _EN.match(text, at) or _FR.match(text, at):
        return m.span()
    if (n := _ZH_AFTER.match(text, at)) and (m := _ZH.search(text, max(0, at - 24), at)):
        cut = [x.end() for x in _ZH_CUT.finditer(m.group(1))]
        return m.start() + (cut[-1] if cut else 0), n.end()
    if (n := _JA_AFTER.match(text, at)) and (m := _JA.search(text, max(0, at - 24), at)):
        return m.start(), n.end()
    return None


def _names(text: str, low: str, lexicon: Lexicon) -> list[tuple[int, int, str]]:
    out = []
    role = lexicon.role
    words = []  # (start, end, role)
    for m in _CAPITAL.finditer(text):
        w = m.group()
        if r := role(w):
            words.append((m.start(), m.end(), r))
        elif len(w) == 1 and text[m.end() : m.end() + 1] == ".":
            words.append((m.start(), m.end() + 1, "I"))
    if len(words) > 1:
        run, shape = [words[0]], words[0][2]
        for w in words[1:]:
            gap = text[run[-1][1] : w[0]]
            m = _GAP.fullmatch(gap) if len(gap) < 14 else None
            if m and m.group(1).strip() in ("", ",") and (gap != "" or run[-1][2] == "I"):
                shape += "C" * ("," in gap) + "P" * bool(m.group(2)) + w[2]
                run += [None] * (("," in gap) + bool(m.group(2))) + [w]
            else:
                out += _named(run, shape)
                run, shape = [w], w[2]
        out += _named(run, shape)
    for m in _introduced(text, low):
        a, b = m.span(1)
        if not any(a < y and x < b for x, y, _ in out):
            value = m.group(1).rstrip()
            parts = value.replace(",", "").split()
            if len(parts) >= 2 and sum(len(p) > 2 for p in parts) >= 1:
                out.append((a, a + len(value), "USER_NAME"))
    if _HAN.search(text):
        out += [(a, b, "USER_NAME") for a, b in lexicon.han_names(text)]
        for m in _INTRODUCED_CJK.finditer(text):
            k = 1 if m.group(1) else 2
            if not any(m.start(k) < y and x < m.end(k) for x, y, _ in out):
                out.append((m.start(k), m.end(k), "USER_NAME"))
    return out


def _introduced(text: str, low: str):
    if len(low) != len(text):
        yield from _INTRODUCED.finditer(text)
        return
    for word in _INTRODUCERS:
        at = low.find(word)
        while at >= 0:
            if m := _INTRODUCED.search(text, max(0, at - 14), min(len(text), at + 90)):
                yield m
            at = low.find(word, at + len(word))


def _named(run: list, shape: str) -> list[tuple[int, int, str]]:
    if len(shape) < 2:
        return []
    return [(run[m.start()][0], run[m.end() - 1][1], "USER_NAME") for m in _NAME_SHAPE.finditer(shape) if run[m.start()] and run[m.end() - 1]]


# ---- tables ----


def lexicon_from(reported: DataFrame) -> Lexicon:
    """From rows (span_text, entity_type), as ``learn`` has it: words are counted and chosen over all spans in Spark.

    All words that pass the test are used. The driver writes them one by one to a file, which every executor gets.
    """
    rows = reported.where(F.col("span_text").isNotNull()).groupBy("span_text", "entity_type").agg(F.count("*").alias("n"))

    def make():
        def work(texts, kinds, counts):
            found = [x for t, k, n in zip(texts, kinds, counts) for x in word_counts(t, k, n)]
            return list(zip(*found)) if found else [[]] * 6

        return work

    measures = ["seen", "named", "first", "last"]
    schema = "word string, han boolean, seen bigint, named bigint, first bigint, last bigint"
    counted = map_rows(rows, make, schema, [pa.string(), pa.bool_(), *[pa.int64()] * 4]).groupBy("word", "han").agg(*[F.sum(c).alias(c) for c in measures])
    counted = counted.where(F.col("han") | is_name_word(*map(F.col, measures))).persist()
    try:
        return _kept(_roles(counted))
    finally:
        counted.unpersist()


def _roles(counted: DataFrame) -> DataFrame:
    """word, roles of what ``lexicon_of`` takes."""
    words = counted.where(~F.col("han")).select("word", F.when(F.col("first") > F.col("last"), "G").otherwise("S").alias("role"))
    names = counted.where("han").select("word", "named", F.expr("left(word, length(word) - 2)").alias("head"), F.expr("right(word, 2)").alias("tail"))
    for name, by, test in (("shared", "tail", F.lit(True)), ("surname", "head", F.col("shared")), ("given", "tail", F.col("surname"))):
        names = names.withColumn(name, F.count_if(test).over(Window.partitionBy(by)) >= 2)
    whole = (F.col("named") >= LEAST_WHOLE) & ~F.col("surname") & F.col("given") & (F.length("word") <= 5)
    parts = [F.struct(F.when(test, F.col(word)).alias("word"), F.lit(role).alias("role")) for test, word, role in ((F.col("given"), "tail", "g"), (F.col("surname"), "head", "s"), (whole, "word", "w"))]
    both = words.unionByName(names.select(F.inline(F.array(*parts))).where(F.col("word").isNotNull()))
    return both.groupBy("word").agg(F.array_join(F.array_sort(F.collect_set("role")), "").alias("roles"))


def _kept(roles: DataFrame) -> Lexicon:
    """The rows (word, roles) as a file in the hands of all executors, until the process ends."""
    folder = tempfile.mkdtemp(prefix="veilframe-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder, f"words-{uuid.uuid4().hex}.db")
    db = sqlite3.connect(path, isolation_level=None)
    try:
        db.execute("PRAGMA journal_mode = OFF")
        db.execute("CREATE TABLE words (word TEXT PRIMARY KEY, roles TEXT) WITHOUT ROWID")
        db.execute("BEGIN")
        db.executemany("INSERT INTO words VALUES (?, ?)", roles.sortWithinPartitions("word").toLocalIterator())
        db.execute("COMMIT")
        firsts = db.execute("SELECT DISTINCT substr(word, 1, 1) FROM words WHERE roles GLOB '*[sw]*'").fetchall()
    finally:
        db.close()
    roles.sparkSession.sparkContext.addFile(str(path))
    return Lexicon(Words(path.name), "".join(c for (c,) in firsts))


SPANS = "src string, record_id bigint, start_pos bigint, end_pos bigint, entity_type string"


def spans(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """src, record_id, start_pos, end_pos, entity_type of rows (src, record_id, text): row-local."""
    roles, firsts = lexicon.roles, lexicon.firsts

    def make():
        own = Lexicon(roles, firsts)

        def work(src, ids, texts):
            columns: list[list] = [[], [], [], [], []]
            a, b, c, d, e = (x.append for x in columns)
            for s, i, text in zip(src, ids, texts):
                for start, end, kind in find(text, own):
                    a(s), b(i), c(start), d(end), e(kind)
            return columns

        return work

    return map_rows(df.where(F.length("text") > 3).select("src", "record_id", "text"), make, SPANS, [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()])


def mask(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """src, record_id, masked_text with placeholders ``__PII_TYPE_n__`` numbered from the left; null stays null."""
    roles, firsts = lexicon.roles, lexicon.firsts

    def make():
        own = Lexicon(roles, firsts)

        def one(text):
            if not text:
                return text
            out, at = [], 0
            for n, (start, end, kind) in enumerate(find(text, own), 1):
                out += (text[at:start], f"__PII_{kind}_{n}__")
                at = end
            return "".join(out) + text[at:]

        def work(src, ids, texts):
            return [src, ids, [one(t) for t in texts]]

        return work

    return map_rows(df.select("src", "record_id", "text"), make, "src string, record_id bigint, masked_text string", [pa.string(), pa.int64(), pa.string()])


def bodies(read) -> DataFrame:
    a = read("mask_in").select(F.lit("mask_in").alias("src"), F.col("request_id").alias("record_id"), "text")
    return a.unionByName(read("call_in").select(F.lit("call_in").alias("src"), F.col("call_id").alias("record_id"), "text"))
