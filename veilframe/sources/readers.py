"""Sources and sinks: text, lines, JSON requests, Parquet; results as reply envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK_IN = "text string, language string"
RESTORE_IN = "text string, maskMeta string"


def tables(spark: SparkSession, folder: str):
    """A function from table name to DataFrame over ``folder/<name>.parquet``."""
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where they come in fewer than half as many splits, as from one small file; else as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: path, text. For very many small files the listing is the limit; prefer Parquet."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def batch(spark: SparkSession, items) -> DataFrame:
    """In-process items, strings or mappings with text and language, in order (column ``pos``)."""
    rows = [(i, x, None) if isinstance(x, str) or x is None else (i, x.get("text"), x.get("language")) for i, x in enumerate(items)]
    return spark.createDataFrame(rows, "pos int, text string, language string").withColumn("text", F.coalesce("text", F.lit("")))


def json_requests(spark: SparkSession, path: str, schema: str = MASK_IN) -> DataFrame:
    """JSON lines with a fixed schema; malformed lines give nulls."""
    return spark.read.schema(schema).json(path)


def parse_requests(df: DataFrame, column: str, schema: str = MASK_IN) -> DataFrame:
    return df.withColumn("body", F.from_json(column, schema)).select("*", "body.*").drop("body")


def envelope(df: DataFrame, output_columns: dict, error: str | None = None) -> DataFrame:
    """Reply envelope: ``output`` struct and ``error`` struct (null unless the error column is set)."""
    failed = F.col(error).isNotNull() if error else F.lit(False)
    return df.select(
        "*",
        F.when(~failed, F.struct(*[F.col(c).alias(name) for name, c in output_columns.items()])).alias("output"),
        F.when(failed, F.struct(F.col(error or "__none").alias("message"), F.lit("failed").alias("code"))).alias("error")
        if error
        else F.lit(None).cast("struct<message:string,code:string>").alias("error"),
    )


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def option(name: str, given=None, environ=None, file_values=None, default=None):
    """Precedence of settings: what is given, then the environment (upper case), then the file."""
    import os

    environ = os.environ if environ is None else environ
    if given is not None:
        return given
    value = environ.get(name.upper().replace("-", "_"))
    if value is not None:
        return value
    keys = {name, name.replace("-", "_"), name.replace("_", "-")}
    return next((v for k, v in (file_values or {}).items() if k in keys), default)


def model_settings(values: dict) -> dict:
    """Settings of a chat endpoint from a mapping with hyphen or underscore keys; a missing key is an error."""
    flat = {k.replace("-", "_"): v for k, v in values.items()}
    key = flat.get("openai_api_key") or flat.get("api_key")
    if not key:
        raise ValueError("no API key in the settings")
    return {"api_key": key, "base_url": flat.get("openai_base_url") or flat.get("base_url"), "model": flat.get("openai_model") or flat.get("model")}
