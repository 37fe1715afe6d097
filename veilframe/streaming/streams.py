"""The operators on unbounded input. All are row-local and stateless, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.config import MaskConfig
from veilframe.operators.mask import mask
from veilframe.operators.restore import restore


def read_requests(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def mask_stream(df: DataFrame, text="text", cfg: MaskConfig | None = None, **how) -> DataFrame:
    return mask(df, text, cfg, **how)


def restore_stream(df: DataFrame, masked="masked_text", meta="mask_meta") -> DataFrame:
    return restore(df, masked, meta)


def span_counts(df: DataFrame, time: str, late: str = "1 hour", window: str = "10 minutes", text="text", cfg: MaskConfig | None = None) -> DataFrame:
    """Extension: masked spans per type and time window; the only stateful stream, bounded by its watermark."""
    rows = mask(df.withWatermark(time, late), text, cfg).select(time, F.explode("mask_meta").alias("m"))
    return rows.groupBy(F.window(time, window).alias("w"), F.col("m.entity_type").alias("entity_type")).agg(F.count("*").alias("n"))


def write(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Parquet sink; the checkpoint belongs in a folder all executors share."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
