"""Whole flows: round trip through an outside text function, staged output, multi-text restore."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from veilframe.config import MaskConfig
from veilframe.functions import language as L
from veilframe.operators import mask as M
from veilframe.operators import ner as N
from veilframe.operators.restore import restore
from veilframe.operators.zh_address import merge_addresses


def entity_spans(df: DataFrame, text="text", language="language", items="ner", out="entity_spans") -> DataFrame:
    """Recognizer tokens to spans, with the address grammar for texts in Chinese.

    Only rows in Chinese with an address or organization seed go to the grammar; the
    rest of the batch passes as nulls, so no row is parsed for nothing.
    """
    df = df.withColumn(out, N.bio_spans(F.col(items), F.col(text)))
    spans = F.col(out)
    seeded = L.is_zh_family(F.col(language)) & F.exists(spans, lambda s: s["entity_type"].isin("PHYSICAL_ADDRESS", "ORGANIZATION"))
    return df.withColumn("__zh", merge_addresses(F.when(seeded, F.col(text)), F.when(seeded, spans))).withColumn(out, F.coalesce("__zh", spans)).drop("__zh")


def echo(text: Column) -> Column:
    return text


def external(call: Callable[[list[str]], list[str]]):
    """An outside text function as a column function: one call a batch of rows, Arrow in and out."""
    @pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(call(texts.fillna("").tolist()))

    return run


def round_trip(df: DataFrame, transform=echo, text="text", cfg: MaskConfig | None = None, **how) -> DataFrame:
    """mask, then ``transform`` on the masked text, then restore.

    Adds masked_text, mask_meta, model_output and restored_text: the three stages to choose from.
    """
    return restore(M.mask(df, text, cfg, **how).withColumn("model_output", transform(F.col("masked_text"))), "model_output")


def multi_mask_one_restore(inputs: list[DataFrame], text="text", cfg: MaskConfig | None = None, **how) -> DataFrame:
    """Each input masked on its own, then all restored together: origin, masked_text, mask_meta, restored_text and the text."""
    masked = [M.mask(df.select(text), text, cfg, **how).withColumn("origin", F.lit(n)) for n, df in enumerate(inputs)]
    return restore(reduce(DataFrame.unionByName, masked))
