"""Masking a text line by line: ids restart in each line, each line has its own metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.config import MaskConfig
from veilframe.operators import mask as M
from veilframe.operators import spans as S
from veilframe.operators.restore import restore_text


def mask_lines(df: DataFrame, text="text", cfg: MaskConfig | None = None, masked="masked_text", meta="line_meta", **how) -> DataFrame:
    r"""Splits on ``\r?\n``, masks each line, joins with ``\n``; no shuffle, all within one row.

    ``line_meta`` is an array with one metadata array a line. Null text: null and no lines.
    """
    cfg = cfg or MaskConfig()
    lines = F.split(F.col(text), "\r?\n", -1)
    # the spans of a line are read twice, so they are kept beside it first
    rows = df.withColumn("__lines", F.transform(lines, lambda x: F.struct(x.alias("line"), M.detect(x, cfg, **how).alias("found"))))
    return S.computed(
        rows,
        {
            masked: F.array_join(F.transform("__lines", lambda x: M.splice(x["line"], x["found"])), "\n"),
            meta: F.coalesce(F.transform("__lines", lambda x: M.build_meta(x["line"], x["found"])), F.array().cast(f"array<array<{M.META}>>")),
        },
    ).drop("__lines")


def restore_lines(df: DataFrame, masked="masked_text", meta="line_meta", out="restored_text") -> DataFrame:
    """The inverse; a text with more lines than metadata keeps the further lines as they are."""
    lines = F.split(F.col(masked), "\r?\n", -1)
    return df.withColumn(out, F.array_join(F.transform(lines, lambda x, i: F.when(i < F.size(F.col(meta)), restore_text(x, F.try_element_at(F.col(meta), i + 1))).otherwise(x)), "\n"))
