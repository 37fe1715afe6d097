"""Span algebra as column expressions: find, filter, resolve overlaps.

A span is ``struct<start int, end int, entity_type string, score double, seq int>``
in code points, half-open. Null and empty texts have no spans. Everything is row-local.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.config import PatternSpec
from veilframe.functions.language import let

SPAN = "struct<start:int,end:int,entity_type:string,score:double,seq:int>"
# A private-use character that frames matches; where a text holds it, it is blanked
# for matching only (same length, so offsets hold).
_FRAME = ""
NO_SPANS = f"array<{SPAN}>"
BLOCK = 256  # items a fold takes at once; an even number, so that a slice of gaps and matches begins with a gap
SPANS_TYPE = T.ArrayType(
    T.StructType([T.StructField(n, t) for n, t in (("start", T.IntegerType()), ("end", T.IntegerType()), ("entity_type", T.StringType()), ("score", T.DoubleType()), ("seq", T.IntegerType()))])
)


def no_spans() -> Column:
    return F.array().cast(NO_SPANS)


# The algebra below is SQL text with named inputs: a plan of hundreds of expressions is then built by the
# parser of the session instead of call by call from Python.


def sql(body: str, **inputs: Column) -> Column:
    """``body`` over ``x.<name>``, each input being computed once."""
    given = F.array(F.struct(*[c.alias(n) for n, c in inputs.items()]))
    return F.element_at(F.call_function("transform", given, F.expr(f"x -> {body}")), 1)


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_NONE = f"CAST(array() AS {NO_SPANS})"


def blocks(items: str) -> str:
    """An array in slices of ``BLOCK``: a fold that grows an array copies it at each step, so long ones are folded by slices."""
    return f"transform(sequence(0, CAST(ceil(size({items}) / {BLOCK}) AS INT) - 1), b0 -> slice({items}, b0 * {BLOCK} + 1, {BLOCK}))"


def _running(values: str, step: str) -> str:
    """[0, step(0, v1), step(step(0, v1), v2), ...] of a short array; ``step`` is over ``last`` and ``v``."""
    return f"aggregate({values}, array(0), (sums, v) -> concat(sums, array({_let('last', 'element_at(sums, -1)', step)})))"


def _pieces(spec: PatternSpec) -> str:
    """Gaps and matches of one pattern in turn: one regex pass frames each match and a split cuts there. Null if nothing can match."""
    flags = "(?U" + spec.flags + ")"
    framed = f"regexp_replace(x.f, {quoted(f'{flags}({spec.label})({spec.fast or spec.value})')}, '$1{_FRAME}$2{_FRAME}')"
    # the test must see what the pattern sees: Unicode digits, blanks and case
    conditions = [f"rlike(x.t, {quoted(flags + spec.hint)})"] if spec.hint else []
    if spec.languages:
        conditions.append(f"x.l IN ({', '.join(map(quoted, spec.languages))})")
    return f"CASE WHEN {' AND '.join(conditions) or 'true'} THEN split({framed}, '{_FRAME}') END"


def _located(pieces: str, entity_type: str, score: str, seq: str) -> str:
    """Spans of the matches among the pieces. Only lengths of strings are used, so characters beyond the basic plane count as one."""
    span = f"named_struct('start', a.pos, 'end', a.pos + length(p), 'entity_type', {entity_type}, 'score', {score}, 'seq', {seq})"
    step = f"named_struct('pos', a.pos + length(p), 'hit', NOT a.hit, 'out', CASE WHEN a.hit THEN concat(a.out, array({span})) ELSE a.out END)"
    fold = f"aggregate(b, named_struct('pos', element_at(ends, i + 1), 'hit', false, 'out', {_NONE}), (a, p) -> {step}, a -> a.out)"
    ends = _running("transform(slices, b -> aggregate(b, 0, (n, p) -> n + length(p)))", "last + v")
    by_blocks = _let("slices", blocks(pieces), _let("ends", ends, f"flatten(transform(slices, (b, i) -> {fold}))"))
    return f"CASE WHEN size({pieces}) > 1 THEN {by_blocks} ELSE {_NONE} END"


def find_spans(text: Column, spec: PatternSpec, seq: int = 0) -> Column:
    """All matches of one pattern, left to right; see :func:`all_spans`. Null text has no spans."""
    return all_spans(text, [replace(spec, languages=())], first=seq, min_score=0.0)


def all_spans(text: Column, specs, extra: Column | None = None, language: Column | None = None, min_score: float = 0.5, first: int = 0) -> Column:
    """Spans of all patterns, then ``extra`` spans (entities), in that tie-break order.

    Patterns whose score is below ``min_score`` are left out of the plan, unless a validator may give
    their matches other scores. A pattern bound to languages needs ``language``. What turns matches
    into spans stands in the plan once for all patterns, not once a pattern.
    """
    used = [(n, p) for n, p in enumerate(specs, first) if (p.score >= min_score or p.validate) and (language is not None or not p.languages)]
    parts = []
    if used:
        rows = ", ".join(f"named_struct('p', {_pieces(p)}, 'k', {quoted(p.entity_type)}, 'v', {float(p.score)}D, 'n', {n})" for n, p in used)
        found = sql(
            f"flatten(transform(array({rows}), g -> {_located('g.p', 'g.k', 'g.v', 'g.n')}))",
            t=text, f=F.translate(text, _FRAME, " "), l=F.lit(None).cast("string") if language is None else F.lower(language),
        )
        for n, p in used:
            if p.validate:
                found = F.transform(found, _validated(text, p, n))
        parts.append(found)
    if extra is not None:
        parts.append(F.coalesce(extra, no_spans()))
    return F.coalesce(F.concat(*parts), no_spans()) if parts else no_spans()


def _validated(text: Column, spec: PatternSpec, seq: int):
    def scored(s):
        own = spec.validate(F.substring(text, s["start"] + 1, s["end"] - s["start"])).cast("double")
        return s.withField("score", F.when(s["seq"] == seq, F.coalesce(own, s["score"])).otherwise(s["score"]))

    return scored


def valid(spans: Column, text: Column, min_score: float = 0.5) -> Column:
    """Drops spans under the score and spans that do not lie inside the text."""
    return sql(f"filter(x.s, y -> y.score >= {float(min_score)}D AND y.start >= 0 AND y.start < y.`end` AND y.`end` <= x.n)", s=spans, n=F.length(text))


def dedup_ranges(spans: Column) -> Column:
    """One span per exact range: highest score, then first by seq; ordered by range."""
    keyed = "array_sort(transform(x.s, y -> named_struct('a', y.start, 'b', y.`end`, 'c', -y.score, 'd', y.seq, 'x', y)))"
    same = "size(acc) > 0 AND element_at(acc, -1).start = k.a AND element_at(acc, -1).`end` = k.b"
    return sql(f"aggregate({keyed}, {_NONE}, (acc, k) -> CASE WHEN {same} THEN acc ELSE concat(acc, array(k.x)) END)", s=spans)


def _greedy(spans: str) -> str:
    keyed = f"array_sort(transform({spans}, y -> named_struct('a', -y.score, 'b', y.start - y.`end`, 'c', y.start, 'd', y.seq, 'x', y)))"
    crossed = "exists(acc, z -> z.start < k.x.`end` AND k.x.start < z.`end`)"
    return f"array_sort(aggregate({keyed}, {_NONE}, (acc, k) -> CASE WHEN {crossed} THEN acc ELSE concat(acc, array(k.x)) END))"


def _groups(spans: str) -> str:
    """Spans ordered by start, cut wherever none reaches over the cut; spans of two groups cannot overlap."""
    tops = _running("transform(slices, b -> array_max(transform(b, y -> y.`end`)))", "greatest(last, v)")
    opens = "named_struct('top', greatest(a.top, y.`end`), 'out', concat(a.out, array(y.start >= a.top)))"
    one = f"aggregate(b, named_struct('top', element_at(tops, i + 1), 'out', CAST(array() AS array<boolean>)), (a, y) -> {opens}, a -> a.out)"
    flags = _let("slices", blocks(spans), _let("tops", tops, f"flatten(transform(slices, (b, i) -> {one}))"))
    cuts = _let("flags", flags, "filter(sequence(1, size(flags)), c -> element_at(flags, c))")
    return _let("cuts", cuts, f"transform(cuts, (c, i) -> slice({spans}, c, coalesce(try_element_at(cuts, i + 2), size({spans}) + 1) - c))")


def resolve_overlaps(spans: Column) -> Column:
    """Greedy choice by score, then length, then start, then seq; result ordered by start.

    Touching spans do not overlap. Many spans are first cut into groups that cannot overlap, so
    the work is quadratic only in the spans of one such group.
    """
    by_groups = f"flatten(transform({_groups('o')}, h -> {_greedy('h')}))"
    return sql(_let("o", "array_sort(x.s)", f"CASE WHEN size(o) <= {BLOCK} THEN {_greedy('o')} ELSE {by_groups} END"), s=spans)


def walk(text: Column, spans: Column, each: str) -> Column:
    """``each``, SQL over ``s`` (a span), ``r.n`` (its id), ``r.gap`` (the text before it) and ``r.value`` (its own), for ordered, disjoint spans.

    A substring is sought from the start of its string, so spans are read by blocks, each from its own stretch of the text.
    """
    before = "CASE WHEN i = 0 THEN u.base ELSE element_at(part, greatest(i, 1)).`end` END"
    read = "named_struct('gap', substring(u.t, at - u.base + 1, s.start - at), 'value', substring(u.t, s.start - u.base + 1, s.`end` - s.start), 'n', u.first + i + 1)"
    row = f"transform(part, (s, i) -> {_let('at', before, _let('r', read, each))})"
    base = "CASE WHEN j = 0 THEN 0 ELSE element_at(element_at(slices, greatest(j, 1)), -1).`end` END"
    stretch = f"named_struct('t', substring(x.t, base + 1, element_at(part, -1).`end` - base), 'base', base, 'first', j * {BLOCK})"
    by_blocks = _let("slices", blocks("x.s"), f"flatten(transform(slices, (part, j) -> {_let('base', base, _let('u', stretch, row))}))")
    return sql(f"CASE WHEN size(x.s) > 0 THEN {by_blocks} END", t=text, s=spans)


def merge_spans(left: Column, right: Column, whitelist=None, blacklist=None, threshold: float = 0.0) -> Column:
    """Concatenates two lists, filters by type and score, orders by range and keeps the best span of each range."""
    both = F.concat(F.coalesce(left, no_spans()), F.coalesce(right, no_spans()))
    kept = F.filter(both, lambda s: s["score"] >= threshold)
    if whitelist:
        kept = F.filter(kept, lambda s: s["entity_type"].isin(*whitelist))
    if blacklist:
        kept = F.filter(kept, lambda s: ~s["entity_type"].isin(*blacklist))
    return dedup_ranges(kept)


def min_score_filter(spans: Column, rules, language: Column) -> Column:
    """Per-language thresholds: exact type before ``*``, the language's rule before ``all``.

    rules: rows (lang, entity_type, min_score or None, drop). ``drop`` without a
    threshold removes the type; with one it keeps spans that reach it.
    """
    table = {(lang, kind): (low, drop) for lang, kind, low, drop in rules}
    langs = sorted({lang for lang, _ in table if lang != "all"})

    def verdict(lang, s):
        def of(kind_lang, kind):
            low, drop = table[kind_lang, kind]
            return F.lit(not drop) if low is None else s["score"] >= float(low)

        cases = []
        for kind in sorted({k for _, k in table if k != "*"}):
            at = lang if (lang, kind) in table else "all"
            if (at, kind) in table:
                cases.append((s["entity_type"] == kind, of(at, kind)))
        at = lang if (lang, "*") in table else "all"
        rest = of(at, "*") if (at, "*") in table else F.lit(True)
        return reduce(lambda acc, c: F.when(c[0], c[1]).otherwise(acc), reversed(cases), rest)

    def kept(lang):
        return F.filter(spans, lambda s: verdict(lang, s))

    return reduce(lambda out, lang: F.when(F.lower(language) == lang, kept(lang)).otherwise(out), langs, kept("all"))


def whitelist_filter(spans: Column, allowed: dict, language: Column | None = None) -> Column:
    """Keeps types listed under ``all`` or the row's language; an empty union keeps everything."""
    base = set(allowed.get("all") or ())

    def keep(types):
        return F.filter(spans, lambda s: s["entity_type"].isin(*sorted(types))) if types else spans

    out = keep(base)
    if language is not None:
        for lang in sorted(k for k in allowed if k != "all"):
            out = F.when(F.lower(language) == lang, keep(base | set(allowed[lang] or ()))).otherwise(out)
    return out


def instruction_prefix_end(text: Column) -> Column:
    """Offset after the first colon if it lies within 80 characters and the words before it give an instruction; else 0."""
    at = F.least(*[F.when(F.instr(text, c) > 0, F.instr(text, c)) for c in (":", "：")])
    # Words that mark an instruction.
    worded = F.substring(text, F.lit(1), at - 1).rlike("翻译|如下|translate|following")
    return F.when((at > 1) & (at <= 80) & worded, at).otherwise(0)


def drop_prefix_spans(spans: Column, text: Column) -> Column:
    """Drops spans that end inside the instruction prefix."""
    return let(instruction_prefix_end(text), lambda end: F.filter(spans, lambda s: (end == 0) | (s["end"] > end)))


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that stay computed where they are.

    Read twice by the projection after it, an expression is not moved into what uses the column. A Python
    function over a moved expression would fail: Spark does not find the inputs of one whose nested lambdas use outer variables.
    """
    inner = df.withColumns({f"__{name}": c for name, c in columns.items()})
    return inner.withColumns({name: F.coalesce(f"__{name}", f"__{name}") for name in columns}).drop(*[f"__{name}" for name in columns])


def explode_rows(df: DataFrame, array: str, out: str, *columns) -> DataFrame:
    """One row an element. Unlike a plain ``explode`` this gets no filter of the array's size put before it, which
    would compute the array a second and third time."""
    return df.select(*columns, F.explode_outer(array).alias(out)).where(F.col(out).isNotNull())


def byte_start(text: Column, start: Column) -> Column:
    """UTF-8 offset of a code point offset."""
    return F.octet_length(F.substring(text, F.lit(1), start))
