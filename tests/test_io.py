import json

import pytest
from pyspark.sql import functions as F

from veilframe.__main__ import main
from veilframe.config import MaskConfig
from veilframe.sources import readers as R
from veilframe.streaming import streams


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line one\nline two", encoding="utf-8")
    assert R.whole_texts(spark, str(tmp_path / "a.txt")).first()["text"] == "line one\nline two"
    (tmp_path / "r.json").write_text('{"text": "a", "language": "en"}\nnot json\n')
    assert [r["text"] for r in R.json_requests(spark, str(tmp_path / "r.json")).collect()] == ["a", None]
    assert [tuple(r) for r in R.batch(spark, ["x", {"text": "y", "language": "de"}, None]).orderBy("pos").collect()] == [(0, "x", None), (1, "y", "de"), (2, "", None)]
    parsed = R.parse_requests(spark.createDataFrame([('{"text": "q"}',)], "body string").withColumnRenamed("body", "raw"), "raw")
    assert parsed.first()["text"] == "q"
    row = R.envelope(spark.createDataFrame([("t", None), ("u", "bad")], "m string, e string"), {"text": "m"}, "e").collect()
    assert row[0]["output"]["text"] == "t" and row[0]["error"] is None and row[1]["output"] is None and row[1]["error"]["message"] == "bad"


def test_settings():
    assert R.option("log-level", None, {"LOG_LEVEL": "b"}, {"log_level": "c"}) == "b"
    assert R.option("log-level", "a", {"LOG_LEVEL": "b"}) == "a" and R.option("log-level", None, {}, {"log_level": "c"}) == "c"
    assert R.model_settings({"openai-api-key": "k", "openai_model": "m"})["api_key"] == "k"
    with pytest.raises(ValueError):
        R.model_settings({})


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "2025-01-01 00:00:00", "a@b.io"), (2, "2025-01-01 00:01:00", None), (3, "2025-01-01 00:20:00", "c@d.io e@f.io")], "id int, t string, text string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = streams.read_requests(spark, str(tmp_path / "in"), "id int, t timestamp, text string")
    q = streams.write(streams.restore_stream(streams.mask_stream(stream, cfg=MaskConfig.all())), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["id"]: (r["masked_text"], r["restored_text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1] == ("__PII_EMAIL_ADDRESS_1__", "a@b.io") and got[2] == (None, None)
    q = streams.span_counts(stream, "t").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("counts").collect()) == [1, 2]


def test_command_line(spark, tmp_path):
    spark.createDataFrame([("a@b.io 10 Long Road",)], "text string").write.parquet(str(tmp_path / "in"))
    main(["mask", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "m"), "--mask-config", json.dumps({"maskAll": True})])
    main(["restore", "--input", str(tmp_path / "m"), "--output", str(tmp_path / "r")])
    main(["round_trip", "--stage", "masked_text", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "s")])
    assert spark.read.parquet(str(tmp_path / "r")).first()["restored_text"] == "a@b.io 10 Long Road"
    assert "restored_text" not in spark.read.parquet(str(tmp_path / "s")).columns
    main(["mask_restore_batch", "--input", str(tmp_path / "in"), str(tmp_path / "in"), "--output", str(tmp_path / "b")])
    assert [r["restored_text"] for r in spark.read.parquet(str(tmp_path / "b")).collect()] == ["a@b.io 10 Long Road"] * 2
    main(["multi_mask_one_restore", "--input", str(tmp_path / "in"), str(tmp_path / "in"), "--output", str(tmp_path / "o")])
    assert sorted((r["origin"], r["restored_text"]) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [(0, "a@b.io 10 Long Road"), (1, "a@b.io 10 Long Road")]
