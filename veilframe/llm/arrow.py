"""Row-local Python over Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: str, types: list, chunk: int = 2000) -> DataFrame:
    """``make()`` runs once a task and returns a function from columns (lists) to result columns.

    Result columns are lists or Arrow arrays in the order of ``schema``. Batches are cut to ``chunk``
    rows, so that a batch of long texts and its results fit in a worker's memory.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                columns = work(*[c.to_pylist() for c in batch.slice(at, chunk).columns])
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names)

    return df.mapInArrow(run, schema)


def sample(df: DataFrame, keys: list[str], most: int) -> list[Row]:
    """At most ``most`` rows, chosen by a hash of their keys and ordered by it; all rows if they are no more.

    The share of hashes to keep follows from a count, so about as many rows as are wanted leave the
    tasks however many tasks there are, and what the driver receives does not grow with the table.
    """
    total = df.count()
    h = F.xxhash64(*keys)
    share = min(1.0, 1.1 * most / total + 20 / total) if total > most else 1.0
    kept = df if share >= 1 else df.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)))
    return kept.withColumn("__h", h).orderBy("__h", *keys).limit(most).drop("__h").collect()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The DataFrame computed once and kept as files in the folder that the session shares with its executors.

    The folder is ``spark.checkpoint.dir``. Where the session names none, a local master gets a temporary one
    that goes with the process; on a cluster, whose machines would not see it, that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="veilframe-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint()
