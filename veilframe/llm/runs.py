"""Runs of consecutive items collapsed to one row each.

An item's predecessor is the item with the index before it, so whether an item continues
a run is decided between neighbours. Only boundary rows survive: an item that differs from
its predecessor opens a run, and the next opening (lead over starts) closes it: the
difference of positions is the count, the previous end the extent.

Long sequences are cut into blocks of ``BLOCK`` indexes, each with the last item of the
block before it, so no sequence is held by one task. The pieces of runs that cross blocks, at
most two a block, are joined afterwards within ``WIDE`` indexes, and what crosses those, at
most two a stretch, within the whole sequence.

Items delivered twice, (sequence, index) repeated, count once, one that can belong to a run before
one that cannot. A null label, the label O and null offsets belong to no run and break it. Null
sequence ids form no runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512
WIDE = BLOCK << 12
BACK, AHEAD = 2, 1  # tolerated distance of a start before the previous start and after the previous end


def label_core(label):
    """Without a leading B, I, E or S and its dash, in upper case."""
    return F.upper(F.regexp_replace(label, F.lit("^[BIESbies][-_]"), F.lit("")))


def collapse(items: DataFrame, key="request_id", index="token_index", label="entity", start="start_pos", end="end_pos") -> DataFrame:
    """key, label_core, first_index, last_index, n_items, start_pos, end_pos, duration (end less start): one row a run, single items included."""
    core = label_core(F.col(label))
    fit = core.isNotNull() & (core != "") & (F.upper(F.col(label)) != "O") & F.col(start).isNotNull() & F.col(end).isNotNull()
    x = items.where(F.col(key).isNotNull() & F.col(index).isNotNull() & fit).select(
        F.col(key).alias("k"), F.col(index).alias("i"), F.struct(core.alias("l"), F.col(start).alias("s"), F.col(end).alias("e")).alias("v")
    )
    kept = x.groupBy("k", "i").agg(F.min("v").alias("v"))
    block = F.floor(F.col("i") / BLOCK)
    # the last index of a block is also shown to the next block, as a predecessor only
    homes = F.when(F.pmod("i", F.lit(BLOCK)) == BLOCK - 1, F.array(block, block + 1)).otherwise(F.array(block))
    rows = kept.select("k", "i", F.col("v.l").alias("l"), F.col("v.s").alias("s"), F.col("v.e").alias("e"), block.alias("home"), F.explode(homes).alias("b"))
    w = Window.partitionBy("k", "b").orderBy("i")
    p = {c: F.lag(c).over(w) for c in ("i", "l", "s", "e")}
    linked = (F.col("i") == p["i"] + 1) & (F.col("l") == p["l"]) & F.col("s").between(p["s"] - BACK, p["e"] + AHEAD)
    marked = rows.select("k", "b", "i", "l", "s", "e", (F.col("home") == F.col("b")).alias("own"), F.coalesce(linked, F.lit(False)).alias("linked"), p["i"].alias("pi"), p["e"].alias("pe"))
    # boundary rows: openings, the first own row of a block where a run comes in, and the last one, which closes what is open
    edge = marked.where("own").withColumns({"opens": ~F.col("linked") | (F.row_number().over(w) == 1), "closes": F.lead("i").over(w).isNull()})
    bound = edge.where("opens OR closes")
    n = F.lead(F.struct("opens", "i", "e", "pi", "pe")).over(w)
    part = bound.withColumn("n", n).where("opens").select(
        "k", "l", F.col("i").alias("first_index"), "s", F.col("linked").alias("comes"),
        F.when(F.col("n").isNull(), F.col("i")).when(F.col("n.opens"), F.col("n.pi")).otherwise(F.col("n.i")).alias("last_index"),
        F.when(F.col("n").isNull(), F.col("e")).when(F.col("n.opens"), F.col("n.pe")).otherwise(F.col("n.e")).alias("e"),
    )
    done = []
    for reach, size in ((BLOCK, WIDE), (WIDE, None)):
        # pieces that touch the edge of their stretch may continue elsewhere
        crosses = F.col("comes") | (F.pmod("last_index", F.lit(reach)) == reach - 1)
        done.append(part.where(~crosses))
        part = _joined(part.where(crosses), F.lit(0) if size is None else F.floor(F.col("first_index") / size))
    out = reduce(DataFrame.unionByName, [*done, part])
    return out.select(
        F.col("k").alias(key),
        F.col("l").alias("label_core"),
        "first_index",
        "last_index",
        (F.col("last_index") - F.col("first_index") + 1).alias("n_items"),
        F.col("s").alias("start_pos"),
        F.col("e").alias("end_pos"),
        (F.col("e") - F.col("s")).alias("duration"),
    )


def _joined(pieces: DataFrame, stretch) -> DataFrame:
    """Pieces of runs joined to the piece before them if that lies in the same stretch of the sequence."""
    at = pieces.withColumn("b", stretch)
    v = Window.partitionBy("k", "b").orderBy("first_index")
    runs = at.withColumn("run", F.sum(F.when(F.col("comes"), 0).otherwise(1)).over(v))
    first = {c: F.min_by(c, "first_index").alias(c) for c in ("l", "s", "comes")}
    return runs.groupBy("k", "b", "run").agg(*first.values(), F.min("first_index").alias("first_index"), F.max("last_index").alias("last_index"), F.max_by("e", "first_index").alias("e")).drop("b", "run")
