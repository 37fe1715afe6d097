"""A few named queries on the small tables against their SQL; the rest is compared by tools/compare.py."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from veilframe.plans import queries as core

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", ["mask_all", "prefix_drop", "ner_bio_spans", "merge_spans", "mask_lines", "zh_script_score"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = core.Q[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(cols).collect())))
    want = sorted(map(repr, con.sql(f"SELECT {', '.join(cols)} FROM ({core.SQL[name]})").fetchall()))
    assert got == want


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
