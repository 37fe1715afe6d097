"""Chinese postal addresses grown from recognizer seeds.

A seed (address or organization span) is read as a sequence of graded parts, from
country (11) down to room (1). It is then extended to the right by the next lower
part, or by one of a few permitted jumps, and to the left by the next higher one, and
kept only if it identifies a home: a house number, or a named place with floor or room.

Everything happens inside one text, so it is a scalar Arrow function. Distances that
the rules state in bytes are measured in UTF-8 widths of the characters; all offsets
are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pandas as pd
from pyspark.sql.functions import pandas_udf

from veilframe.operators.spans import SPANS_TYPE

ROOM, FLOOR, BUILDING, PLACE, HOUSE, ROAD, TOWNSHIP, DISTRICT, CITY, PROVINCE, COUNTRY = range(1, 12)

# The lexicons of the grammar; order within a list is the order of trial.
LIGHT = " \t\r\n,"
HEAVY = "。！？；：、（）/\\|"
COUNTRIES = "中国 中華人民共和國 中华人民共和国 中國大陸 中国大陆 臺灣 台湾 香港 澳門 澳门 英國 英国 美國 美国 日本".split()
PROVINCES = "省 自治区 自治州 盟 地区 特别行政区".split()
DISTRICTS = "区 區 县 縣 旗".split()
DISTRICT_NAMES = "新界 九龙 九龍".split()
PARKS = "科技园 科学园 工业园 工业区 产业园 科技園 科學園 工業園 工業區 產業園".split()
TOWNSHIPS = ["街道", "镇", "鎮", "乡", "鄉", "开发区", "经济技术开发区", *PARKS]
TOWNSHIP_NAMES = "铜锣湾 銅鑼灣 北角 荃湾 荃灣 将军澳 將軍澳 青衣 上环 上環".split()
ROADS = "大道 大街 环路 环线 道中 道东 道西 道南 道北 路 街 巷 弄 里 道 胡同 段 環路 環線".split()
PLACES = "广场 中心 花园 花苑 苑 城 天地 大厦 大楼 港 塔 廊 坊 里 府 购物公园 购物艺术馆 廣場 花園 大廈 大樓 購物公園 購物藝術館".split()
BUILDINGS = "号楼 号館 號樓 館 栋 棟 幢 座".split()
FLOORS = "层 層 樓 楼".split()
ROOMS = "单元 室 房".split()

WINDOW_BYTES, GROWTH_CHARS, BACK_BYTES, NAME_CHARS = 96, 48, 8, 16


def _any(words, extra: str = "") -> re.Pattern:
    return re.compile("(?:" + "|".join(map(re.escape, words)) + ")" + extra)


_country, _province, _city = _any(COUNTRIES), _any(PROVINCES), re.compile("(?<!城)市")
_district, _district_name = _any(DISTRICTS), _any(DISTRICT_NAMES)
_township, _township_name, _road = _any(TOWNSHIPS), _any(TOWNSHIP_NAMES), _any(ROADS)
_building, _floor, _room = _any(BUILDINGS), _any(FLOORS), _any(ROOMS)
_house_mark = re.compile("[号號](?![楼樓])")
_house_tail = re.compile(rf"[{LIGHT}]*(?:之[{LIGHT}]*|-[{LIGHT}]*)([0-9]+)")
_tail_room = re.compile(rf"之[{LIGHT}]*[0-9]+")
_f_floor = re.compile("F[0-9]+")

# Named parts: (level, names). Suffixed parts: (level, suffix, byte reach to the left, what ends the part before).
_NAMED = {COUNTRY: _country, DISTRICT: _district_name, TOWNSHIP: _township_name}
_SUFFIXED = {PROVINCE: (_province, 32, _country), CITY: (_city, 24, _province), DISTRICT: (_district, 24, _city), TOWNSHIP: (_township, 24, _district), ROAD: (_road, 32, _township)}
_ADMIN_ORDER = ((COUNTRY, True), (PROVINCE, False), (CITY, False), (DISTRICT, True), (DISTRICT, False), (TOWNSHIP, True), (TOWNSHIP, False), (ROAD, False))


def _digit(c: str) -> bool:
    return "0" <= c <= "9"


def _letter(c: str) -> bool:
    return "a" <= c <= "z" or "A" <= c <= "Z"


class _Text:
    """A text with the UTF-8 offset of each character."""

    def __init__(self, text: str):
        self.s = text
        self.at = list(accumulate((len(c.encode("utf-8", "replace")) for c in text), initial=0))

    def index(self, byte: int) -> int:
        """First character that begins at or after a byte."""
        return bisect_left(self.at, byte)

    def head(self, lo: int, end: int, reach: int) -> int:
        """Start of the run before ``end`` without separators, at most ``reach`` bytes and not before byte ``lo``."""
        p = end
        while self.at[p] > lo and self.at[end] - self.at[p] < reach and self.s[p - 1] not in LIGHT and self.s[p - 1] not in HEAVY:
            p -= 1
        return p

    def back(self, lo: int, end: int, wanted, stop: str):
        """Nearest wanted character within BACK_BYTES before ``end``; None at a stop character."""
        p = end
        while self.at[p] > lo and self.at[end] - self.at[p] < BACK_BYTES:
            p -= 1
            if self.s[p] in stop:
                return None
            if wanted(self.s[p]) and self.s[p] not in LIGHT:
                return p
        return None

    def run(self, lo: int, p: int, kind) -> int:
        while self.at[p] > lo and kind(self.s[p - 1]):
            p -= 1
        return p


def parts(t: _Text, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(level, start, end) of the parts that begin in bytes [lo, hi), left to right."""
    found: list[tuple[int, int, int]] = []
    i = t.index(lo)
    while i < len(t.s) and t.at[i] < hi:
        got = [] if t.s[i] in LIGHT else _parts_at(t, lo, hi, i)
        found += got
        i = max(i + 1, got[-1][2]) if got else i + 1
    if len(found) > 1:
        last = found[-1][0]
        found = [p for p in found[:-1] if p[0] >= last] + found[-1:]
    return found


def _parts_at(t: _Text, lo: int, hi: int, i: int) -> list[tuple[int, int, int]]:
    s = t.s
    for level, named in _ADMIN_ORDER:
        pattern, reach, before = (_NAMED[level], 0, None) if named else _SUFFIXED[level]
        if not (m := pattern.match(s, i)):
            continue
        start = i
        if not named:
            start = t.head(lo, i, reach)
            for cut in before.finditer(s, start):
                if cut.start() >= i:
                    break
                start = cut.end()
        return [(level, start, m.end())]
    if _house_mark.match(s, i) and (p := t.back(lo, i, _digit, "")) is not None:
        end = i + 1
        if (m := _house_tail.match(s, end)) and t.at[m.start(1)] < hi:
            end = min(m.end(), max(t.index(hi), m.start(1) + 1))
        return [(HOUSE, t.run(0, p, _digit), end)]
    if place := _place(t, hi, i):
        return place
    if (m := _building.match(s, i)) and (p := t.back(lo, i, lambda c: _digit(c) or _letter(c), "")) is not None:
        return [(BUILDING, t.run(lo, p, (lambda c: _digit(c) or _letter(c)) if _digit(s[p]) else _letter), m.end())]
    if m := _floor.match(s, i):
        if (p := t.back(lo, i, _digit, LIGHT)) is not None:
            return [(FLOOR, t.run(lo, p, _digit), m.end())]
    elif m := _f_floor.match(s, i):
        return [(FLOOR, i, m.end())]
    if m := _tail_room.match(s, i):
        return [(ROOM, i, m.end())]
    if (m := _room.match(s, i)) and (p := t.back(lo, i, lambda c: _digit(c) or _letter(c), LIGHT)) is not None:
        return [(ROOM, t.run(lo, p, _digit if _digit(s[p]) else _letter), m.end())]
    return []


def _place(t: _Text, hi: int, i: int) -> list[tuple[int, int, int]]:
    """A named place that begins at i; a road inside it is split off."""
    s, j = t.s, i
    while j < len(s) and t.at[j] < hi and j - i < NAME_CHARS and s[j] not in HEAVY and (_letter(s[j]) or s[j] >= "\x80"):
        j += 1
        if s[j - 1] in _PLACE_LAST and _ends_place(s, i, j):
            m = _road.search(s, i)
            if m and m.start() < j:
                return [(ROAD, i, m.end()), (PLACE, m.end(), j)]
            return [(PLACE, i, j)]
    return []


_PLACE_LAST = {p[-1] for p in PLACES}


def _ends_place(s: str, i: int, j: int) -> bool:
    for word in PLACES:
        if s.endswith(word, i, j):
            return word != "城" or not re.compile(f"[{LIGHT}]*[区區县縣市]").match(s, j)
    return False


def _near(t: _Text, end: int, start: int, most: int) -> bool:
    return abs(start - end) <= most


def _only_light(t: _Text, end: int, start: int) -> bool:
    return start - end <= 4 and all(c in LIGHT for c in t.s[end:start])


def _ends(t: _Text, start: int, end: int, words) -> bool:
    return any(t.s.endswith(w, start, end) for w in words)


def _road_completes(t: _Text, start, end, a, b) -> bool:
    m = _road.match(t.s, end)
    return (m.end() if m else end) == b


def _overlap(t: _Text, start, end, a, b) -> bool:
    return a <= end < b


# Permitted jumps to the right: (lowest level so far, new level) -> condition on (text, start, end, part start, part end).
_JUMPS = {
    (COUNTRY, TOWNSHIP): lambda t, s, e, a, b: _only_light(t, e, a) and _ends(t, s, e, ["香港"]),
    (TOWNSHIP, BUILDING): lambda t, s, e, a, b: _only_light(t, e, a) and _ends(t, s, e, PARKS),
    (HOUSE, TOWNSHIP): lambda t, s, e, a, b: _ends(t, a, b, PARKS) and (_overlap(t, s, e, a, b) or _near(t, e, a, 4)),
    (ROAD, PLACE): lambda t, s, e, a, b: _only_light(t, e, a),
    (HOUSE, FLOOR): lambda t, s, e, a, b: _near(t, e, a, 4),
    (PLACE, ROAD): _road_completes,
    (PLACE, FLOOR): lambda t, s, e, a, b: _near(t, e, a, 4),
    (PLACE, ROOM): lambda t, s, e, a, b: _near(t, e, a, 5),
    (BUILDING, ROOM): lambda t, s, e, a, b: _near(t, e, a, 6),
    (DISTRICT, ROAD): _overlap,
    (CITY, ROAD): _overlap,
}


def _attach_right(levels: set, t: _Text, start: int, end: int, part) -> set | None:
    level, a, b = part
    low = min(levels, default=0)
    if not low or level + 1 == low:
        return levels | {level}
    allowed = _JUMPS.get((low, level))
    if not allowed or not allowed(t, start, end, a, b):
        return None
    return (levels | {level}) - ({PLACE} if (low, level) == (PLACE, ROAD) else set())


def _attach_left(levels: set, t: _Text, start: int, part) -> set | None:
    level, a, b = part
    high = max(levels, default=0)
    if not high:
        # Nothing is graded yet, so there is nothing to attach to.
        return None
    if level == high + 1 or ((high, level) == (ROAD, DISTRICT) and _ends(t, a, b, DISTRICT_NAMES) and _only_light(t, b, start)):
        return levels | {level}
    return None


def join_adjacent(text: str, spans: list[dict]) -> list[dict]:
    """Address spans separated by nothing but light separators become one with the better score; only seeds stay."""
    out: list[dict] = []
    for span in sorted(spans, key=lambda x: (x["start"], -x["end"])):
        if span["entity_type"] not in ("PHYSICAL_ADDRESS", "ORGANIZATION"):
            out.append({"entity_type": None})
            continue
        last = out[-1] if out else {"entity_type": None}
        both = last["entity_type"] == span["entity_type"] == "PHYSICAL_ADDRESS"
        if both and span["start"] >= last["end"] and all(c in LIGHT for c in text[last["end"] : span["start"]]):
            out[-1] = last | {"end": span["end"], "score": max(last["score"], span["score"])}
        else:
            out.append(dict(span))
    return [x for x in out if x["entity_type"]]


def grow(t: _Text, seed: dict) -> dict | None:
    """The address around a seed, or None if it does not identify a home."""
    first = parts(t, t.at[seed["start"]], t.at[seed["end"]])
    levels = {p[0] for p in first}
    start, end = seed["start"], (first[-1][2] if first else seed["end"])
    while abs(end - seed["end"]) < GROWTH_CHARS:
        private = any(x <= HOUSE for x in levels)
        if end >= len(t.s) or (private and t.s[end] in HEAVY):
            break
        for part in parts(t, t.at[end], min(t.at[-1], t.at[end] + WINDOW_BYTES)):
            if part[0] == DISTRICT and DISTRICT in levels:
                continue
            if private and part[0] >= DISTRICT:
                grown = None
                break
            if grown := _attach_right(levels, t, start, end, part):
                break
        else:
            break
        if not grown:
            break
        levels, start, end = grown, min(start, part[1]), part[2]
    while start > 0 and levels:
        for part in reversed(parts(t, max(0, t.at[start] - WINDOW_BYTES), t.at[start])):
            if part[0] == DISTRICT and DISTRICT in levels:
                continue
            if grown := _attach_left(levels, t, start, part):
                break
        else:
            break
        if part[1] >= start:
            break
        levels, start = grown, part[1]
    if HOUSE not in levels and not (PLACE in levels and levels & {FLOOR, ROOM}):
        return None
    return seed | {"entity_type": "PHYSICAL_ADDRESS", "start": start, "end": end, "score": round(0.9999 - 0.0025 * min(levels), 4)}


def merge_text(text: str, spans: list[dict], seq: int = 200) -> list[dict]:
    """All spans of a text after the address step: raw addresses go, organizations inside an address go, grown addresses come last."""
    seeds = join_adjacent(text, spans)
    t, grown, covered = _Text(text), [], set()
    for i, seed in enumerate(seeds):
        if i in covered:
            continue
        if address := grow(t, seed):
            grown.append(address | {"seq": seq})
            covered |= {j for j in range(i + 1, len(seeds)) if address["start"] <= seeds[j]["start"] and seeds[j]["end"] <= address["end"]}
    kept = [
        x
        for x in spans
        if x["entity_type"] != "PHYSICAL_ADDRESS" and not (x["entity_type"] == "ORGANIZATION" and any(g["start"] <= x["start"] and x["end"] <= g["end"] for g in grown))
    ]
    return kept + grown


@pandas_udf(SPANS_TYPE)
def merge_addresses(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Null where the text is null."""
    return pd.Series([None if t is None else merge_text(t, [dict(x) for x in (s if s is not None else [])]) for t, s in zip(text, spans)])
