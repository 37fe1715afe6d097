"""Cutting long texts into numbered pieces within a limit.

White space and sentence marks cut a text into tokens; the prefix sums of their lengths
are the sorted boundaries. A binary search finds the last boundary within the limit,
preferring the end of a paragraph, then of a sentence, then of a word, and the next piece
starts ``overlap`` characters before the cut. Where no boundary is in reach, the cut is
hard: at the limit, though not between a letter and its combining marks.

Texts within the limit are one piece and never leave the JVM; null texts have no piece,
empty ones an empty piece. Limits under one character count as one, an overlap at or
above the limit as the limit less one.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from veilframe.llm.arrow import map_rows

MAX_LIMITS = 1000  # rows of the table of limits, which is read by the driver
STOPS = ".!?…。！？"
_SPACES = np.array(sorted(c for c in range(0x3001) if chr(c).isspace()), np.uint32)
_STOPS = np.array(sorted(map(ord, STOPS)), np.uint32)
_BREAKS = np.array([10, 13, 0x0B, 0x0C, 0x85, 0x2028, 0x2029], np.uint32)


def boundaries(text: str) -> tuple[list[np.ndarray], int]:
    """Sorted cut positions (paragraphs, sentences, words), and the longest stretch without any mark."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    space = np.isin(codes, _SPACES)
    stop = np.isin(codes, _STOPS)
    mark = np.flatnonzero(space | stop)
    edges = np.concatenate(([-1], mark, [n]))
    longest = int(np.diff(edges).max()) - 1
    last = np.ones(n, bool)  # the last of a run of marks of its kind
    last[:-1] = ~(space[1:] & space[:-1] | stop[1:] & stop[:-1])
    lengths = np.diff(np.concatenate(([-1], np.flatnonzero((space | stop) & last))))
    words = np.cumsum(lengths)  # prefix sums of token lengths
    lines = np.isin(codes, _BREAKS)
    wide = codes > 0x3000
    ends = stop & np.concatenate((space[1:] | wide[1:] | stop[1:], [True])) if n else stop
    sentences = np.flatnonzero(ends & last) + 1
    paragraphs = np.flatnonzero(lines & ~np.concatenate((lines[1:], [False]))) + 1
    return [paragraphs, sentences, words], longest


def cut(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, bool]], bool]:
    """((start, end, hard) of each piece, whether a stretch without marks exceeds the limit)."""
    limit = max(1, limit)
    overlap = min(max(0, overlap), limit - 1)
    levels, longest = boundaries(text)
    out, start, n = [], 0, len(text)
    while n - start > limit:
        end, hard = 0, False
        for level, least in zip(levels, (start + (limit + overlap) // 2, start + (limit + overlap) // 2, start + overlap)):
            k = int(np.searchsorted(level, start + limit, side="right")) - 1
            if k >= 0 and level[k] > max(least, start + overlap):
                end = int(level[k])
                break
        else:
            end, hard = start + limit, True
            back = end
            while back > start + overlap + 1 and back < n and unicodedata.combining(text[back]):
                back -= 1
            end = back if back > start + overlap + 1 else end
        out.append((start, end, hard))
        start = end - overlap
    out.append((start, n, False))
    return out, longest > limit


def limits_of(table: DataFrame) -> dict[str, tuple[int, int]]:
    """model -> (max_chars, overlap_chars), keys in lower case without outer blanks."""
    rows = table.select("model", "max_chars", "overlap_chars").limit(MAX_LIMITS + 1).collect()
    if len(rows) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits")
    return {(r[0] or "").strip().lower(): (int(r[1]), int(r[2])) for r in rows}


def with_limit(df: DataFrame, limits: dict, model=None, row: str = "default", overrides: dict | None = None) -> DataFrame:
    """Adds max_chars and overlap_chars: the row of the model, else the fixed ``row``."""
    table = F.create_map(*[F.lit(x) for k, (a, b) in sorted(limits.items()) for x in (k, F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))])
    name = F.lit(row) if model is None else F.regexp_replace(F.lower(F.coalesce(F.col(model), F.lit(""))), F.lit(r"(?U)^\s+|\s+$"), F.lit(""))
    own = F.coalesce(F.try_element_at(table, name), F.try_element_at(table, F.lit(row)))
    return df.withColumns({"max_chars": own["a"], "overlap_chars": own["b"]})


_PIECES = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("piece_no", T.IntegerType()), ("start_pos", T.IntegerType()), ("end_pos", T.IntegerType()), ("hard", T.BooleanType()), ("forced", T.BooleanType()), ("piece", T.StringType()))]))
SCHEMA = "src string, record_id bigint, piece_no int, start_pos int, end_pos int, hard boolean, forced boolean, piece string"


def split_long(df: DataFrame, with_text: bool = True) -> DataFrame:
    """Pieces of rows (src, record_id, text, max_chars, overlap_chars) whose text exceeds its limit."""

    def make():
        def work(src, ids, texts, limits, overlaps):
            columns: list[list] = [[] for _ in range(8)]
            for s, i, text, limit, overlap in zip(src, ids, texts, limits, overlaps):
                found, forced = cut(text, limit, overlap)
                for number, (a, b, hard) in enumerate(found, 1):
                    for c, v in zip(columns, (s, i, number, a, b, hard, forced, text[a:b] if with_text else None)):
                        c.append(v)
            return columns

        return work

    long = df.where(F.length("text") > F.col("max_chars")).select("src", "record_id", "text", "max_chars", "overlap_chars")
    return map_rows(long, make, SCHEMA, [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()])


def split(df: DataFrame) -> DataFrame:
    """Pieces of all rows, in one pass: only the texts above their limit are shown to Python, the others are their own piece."""

    @pandas_udf(_PIECES)
    def cut_all(texts: pd.Series, limits: pd.Series, overlaps: pd.Series) -> pd.Series:
        def one(text, limit, overlap):
            if text is None:
                return None
            found, forced = cut(text, int(limit), int(overlap))
            return [{"piece_no": n, "start_pos": a, "end_pos": b, "hard": hard, "forced": forced, "piece": text[a:b]} for n, (a, b, hard) in enumerate(found, 1)]

        return pd.Series([one(*x) for x in zip(texts, limits, overlaps)])

    text = F.col("text")
    long = F.length(text) > F.col("max_chars")
    rows = df.where(text.isNotNull() & F.col("max_chars").isNotNull()).withColumn("p", cut_all(F.when(long, text), "max_chars", "overlap_chars"))
    rows = rows.select("src", "record_id", "text", F.explode_outer("p").alias("p"))
    short = F.struct(F.lit(1).alias("piece_no"), F.lit(0).alias("start_pos"), F.length(text).alias("end_pos"), F.lit(False).alias("hard"), F.lit(False).alias("forced"), text.alias("piece"))
    return rows.select("src", "record_id", F.coalesce("p", short).alias("p")).select("src", "record_id", "p.*")


def bodies(read) -> DataFrame:
    """Rows of mask_in and call_in with their limits; ``read`` gives a table by name."""
    limits = limits_of(read("model_limits"))
    mask = with_limit(read("mask_in").select(F.lit("mask_in").alias("src"), F.col("request_id").alias("record_id"), "text"), limits, row="mask_in")
    call = with_limit(read("call_in").select(F.lit("call_in").alias("src"), F.col("call_id").alias("record_id"), "text", "model"), {k: v for k, v in limits.items() if k != "mask_in"}, "model").drop("model")
    return reduce(DataFrame.unionByName, [mask, call])
