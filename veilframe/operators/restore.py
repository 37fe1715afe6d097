"""Restoring masked text from metadata, strictly (core) or leniently (rules)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.mask import placeholder


def restore_text(masked: Column, meta: Column) -> Column:
    """Puts each original back at the first occurrence of its placeholder.

    Positions are those in the masked text, so originals that look like placeholders
    are not expanded again, and the order of the metadata does not matter. A
    placeholder that is missing from the text is skipped; a second occurrence stays.
    If the source itself held the literal text of an assigned placeholder, the first
    occurrence wins. Empty and null text come back as they are; null metadata changes nothing.
    """
    hits = F.transform(
        F.coalesce(meta, F.array().cast("array<struct<entity_id:int,entity_type:string,matched_text:string,score:double>>")),
        lambda m: F.struct(
            F.instr(masked, placeholder(m["entity_type"], m["entity_id"])).alias("at"), F.length(placeholder(m["entity_type"], m["entity_id"])).alias("n"), m["matched_text"].alias("put")
        ),
    )
    ordered = F.array_sort(F.filter(hits, lambda h: h["at"] > 0))
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    spliced = F.aggregate(
        ordered,
        start,
        lambda acc, h: F.when(h["at"] - 1 < acc["pos"], acc).otherwise(
            F.struct((h["at"] - 1 + h["n"]).alias("pos"), F.concat(acc["out"], F.substring(masked, acc["pos"] + 1, h["at"] - 1 - acc["pos"]), h["put"]).alias("out"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(masked, acc["pos"] + 1, F.length(masked))),
    )
    return F.when(masked.isNotNull(), spliced)


def restore(df: DataFrame, masked: str = "masked_text", meta: str = "mask_meta", out: str = "restored_text") -> DataFrame:
    return df.withColumn(out, restore_text(F.col(masked), F.col(meta)))


def _quoted(value: Column) -> Column:
    r"""A literal inside a Java pattern; ``\E`` in the value is taken apart."""
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _plain(value: Column) -> Column:
    """A value for use as a replacement: backslash and dollar lose their meaning."""
    return F.regexp_replace(value, F.lit(r"([\\$])"), F.lit(r"\\$1"))


def placeholder_map(meta: Column) -> Column:
    """Metadata as placeholder -> original."""
    return F.map_from_entries(F.transform(meta, lambda m: F.struct(placeholder(m["entity_type"], m["entity_id"]), m["matched_text"])))


def restore_lenient(masked: Column, mapping: Column) -> Column:
    """Three passes over ``map<placeholder, original>``.

    1. every exact placeholder, all occurrences, in map order;
    2. ``<original><id>__`` loses the leaked suffix, ignoring case;
    3. damaged placeholders (missing underscores, other type name) are resolved by
       their numeric id; an unknown id stays as it is.
    Null map: the text unchanged. Null text: null.
    """
    entries = F.coalesce(F.map_entries(mapping), F.array().cast("array<struct<key:string,value:string>>"))
    exact = F.aggregate(entries, masked, lambda t, e: F.replace(t, e["key"], e["value"]))
    ids = F.transform(
        F.filter(entries, lambda e: e["key"].rlike(r"_(\d+)__$")), lambda e: F.struct(F.regexp_extract(e["key"], r"_(\d+)__$", 1).alias("id"), e["value"].alias("value"))
    )
    unsuffixed = F.aggregate(ids, exact, lambda t, e: F.regexp_replace(t, F.concat(F.lit("(?iu)"), _quoted(e["value"]), e["id"], F.lit("__")), _plain(e["value"])))
    # pieces: damaged placeholders framed, then looked up one by one
    frame = ""
    pieces = F.split(F.regexp_replace(unsuffixed, F.lit(r"(?iu)_{0,2}PII[\w-]*_\d+_{0,2}"), F.lit(f"{frame}$0{frame}")), frame)

    def value(piece):
        uid = F.regexp_extract(piece, r"(?i)PII[\w-]*_(\d+)_{0,2}$", 1)
        hit = F.filter(ids, lambda e: e["id"] == uid)
        return F.when(F.size(hit) > 0, F.element_at(hit, -1)["value"]).otherwise(piece)

    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, value(p)).otherwise(p)), "")
