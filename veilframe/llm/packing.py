"""Filling containers of fixed capacity: first-fit decreasing in randomised groups.

Items fall into groups of about ``GROUP`` by a hash of their key, so groups are equal in
size whatever the sources look like, and each is packed alone. Within a group a
tournament tree over the free space of the containers finds the first one that fits in
logarithmic time. An item larger than the capacity fills whole containers and its rest is
packed like any other item; nothing else is split.

Null and empty texts are items of size 0 and get a container too. Ties go by key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = 20_000
MAX_TASKS = 4_000
MAX_PACKS = 1000  # rows of the table of capacities, which is read by the driver


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container of each item; sizes in decreasing order, none above the capacity."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    out = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        out.append(node - leaves)
        tree[node] -= size
        node //= 2
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            best = a if a >= b else b
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return out


def pack(df: DataFrame, packs: DataFrame, key: str = "doc_id", size: str = "n_tokens", n: int | None = None) -> DataFrame:
    """pack_name, doc_id, part_no, group_no, container_no, n_tokens: one row a part.

    ``packs`` (pack_name, capacity_tokens) must be a small table; one shuffle of (key, size) pairs.
    ``n``, the number of items if it is known, saves a pass over ``df``.
    """
    given = sorted((r[0], int(r[1])) for r in packs.select("pack_name", "capacity_tokens").where("capacity_tokens > 0").distinct().limit(MAX_PACKS + 1).collect())
    if len(given) > MAX_PACKS:
        raise ValueError(f"more than {MAX_PACKS} capacities")
    n = df.count() if n is None else n
    groups = max(1, -(-n // GROUP))
    kind = df.schema[key].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        group = table.column("group_no")[0].as_py()
        keys, sizes = table.column(key).to_pylist(), table.column(size).to_numpy()
        columns: list[list] = [[], [], [], [], [], []]
        for name, capacity in given:
            full = np.where(sizes > capacity, (sizes - 1) // capacity, 0)
            rest = sizes - full * capacity
            order = sorted(range(len(keys)), key=lambda i: (-rest[i], keys[i] is None, keys[i]))
            bins = first_fit_decreasing([int(rest[i]) for i in order], capacity)
            used = max(bins, default=-1) + 1
            for i, b in zip(order, bins):
                parts = [(k, used + k, capacity) for k in range(int(full[i]))] + [(int(full[i]), b, int(rest[i]))]
                used += int(full[i])
                for part, container, tokens in parts:
                    for c, v in zip(columns, (name, keys[i], part, group, container, tokens)):
                        c.append(v)
        names = ["pack_name", key, "part_no", "group_no", "container_no", "n_tokens"]
        kinds = [pa.string(), table.schema.field(key).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    grouped = df.select(key, F.col(size).cast("bigint").alias(size), F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(groups)).alias("group_no"))
    # one task a group, up to a bound: the rows are few bytes but much work
    return grouped.repartition(min(groups, MAX_TASKS), "group_no").groupBy("group_no").applyInArrow(run, f"pack_name string, {key} {kind}, part_no int, group_no bigint, container_no bigint, n_tokens bigint")
