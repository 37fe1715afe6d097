"""spark-submit entry: ``python -m veilframe VERB --input P [P ...] --output P [...]`` over Parquet.

mask, restore, round_trip: one text column in, the columns of the operator out. mask_restore_batch masks
and restores all inputs as one batch; multi_mask_one_restore masks each input on its own, as separate
calls would, and restores all of them in one job (column ``origin`` numbers the inputs).
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from veilframe.config import MaskConfig
from veilframe.operators.mask import mask
from veilframe.operators.restore import restore
from veilframe.plans.pipelines import multi_mask_one_restore, round_trip
from veilframe.sources.readers import option


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="veilframe")
    p.add_argument("verb", choices=["mask", "restore", "round_trip", "mask_restore_batch", "multi_mask_one_restore"])
    p.add_argument("--input", required=True, nargs="+")
    p.add_argument("--output", required=True)
    p.add_argument("--text", default="text")
    p.add_argument("--profile", choices=["core", "rules"], default="core")
    p.add_argument("--mask-config", help="JSON object of switches; else the variable MASK_CONFIG")
    p.add_argument("--stage", choices=["masked_text", "model_output", "restored_text"], help="keep only this text of the round trip")
    a = p.parse_args(argv)
    cfg = MaskConfig.from_dict(json.loads(option("mask_config", a.mask_config, default="{}")), a.profile)
    spark = SparkSession.builder.appName("veilframe").getOrCreate()
    df = spark.read.parquet(*a.input)
    if a.verb == "multi_mask_one_restore":
        df = multi_mask_one_restore([spark.read.parquet(path) for path in a.input], a.text, cfg, profile=a.profile)
    elif a.verb == "mask_restore_batch":
        df = restore(mask(df, a.text, cfg, profile=a.profile))
    elif a.verb == "mask":
        df = mask(df, a.text, cfg, profile=a.profile)
    elif a.verb == "restore":
        df = restore(df)
    else:
        df = round_trip(df, text=a.text, cfg=cfg, profile=a.profile)
        if a.stage:
            df = df.drop(*({"masked_text", "model_output", "restored_text"} - {a.stage}))
    df.write.mode("errorifexists").parquet(a.output)


if __name__ == "__main__":
    main()
