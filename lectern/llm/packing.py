"""Filling containers of fixed capacity with items of varying size.

First-fit decreasing, run independently in randomised groups of items: the next
item in falling order of size goes into the first open container with room for
it, found by descent in a tournament tree of the room left. Only sizes and keys
are shuffled. A group is a few thousand items whatever the table's size, and
what its last container leaves empty is all that grouping costs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a group, on average.
GROUP_ITEMS = 16_384


def first_fit(sizes: Sequence[int], capacity: int) -> list[int]:
    """The bin of each size, in the order given; bins are opened as needed."""
    leaves = 1 << max(len(sizes) - 1, 0).bit_length()
    room = [capacity] * (2 * leaves)  # room[i]: the most room below node i; bins are the leaves
    bins = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins.append(node - leaves)
        room[node] -= size
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return bins


def pieces_of(items: DataFrame, capacity: int) -> DataFrame:
    """`key, piece, begins, size`: items above the capacity in full pieces and a rest."""
    begins = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(capacity).cast("long"))
    return items.filter("size > 0").select("key", "size", F.posexplode(begins).alias("piece", "begins")).select(
        "key", "piece", "begins", F.least(F.col("size") - F.col("begins"), F.lit(capacity)).alias("size")
    )


def fill_containers(items: DataFrame, capacity: int, rows: int | None = None, group_items: int = GROUP_ITEMS) -> DataFrame:
    """`key, piece, begins, size, container` of every item, or piece of one above the capacity.

    items: `key, size` (long); rows: how many, where that is known without
    computing their sizes. container is a number, its group in the high 32
    bits. Defined cases: null, zero and negative sizes go into none; keys may be
    null or repeat, each row is an item of its own; ties are packed in the order
    of their keys; an empty table gives no rows.
    """
    groups = max(1, -(-(items.count() if rows is None else rows) // group_items))
    key = items.schema["key"].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("key", "ascending"), ("piece", "ascending")])
        bins = first_fit(table.column("size").to_pylist(), capacity)
        containers = (table.column("group")[0].as_py() << 32) + np.array(bins, np.int64)
        return table.drop_columns(["group"]).append_column("container", pa.array(containers, pa.int64()))

    grouped = pieces_of(items, capacity).withColumn("group", F.floor(F.rand(17) * groups))
    return grouped.groupBy("group").applyInArrow(pack, f"key {key}, piece int, begins long, size long, container long")


def fill_report(filled: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, pieces, tokens in them and the share of their room that is used."""
    by = filled.groupBy("container").agg(F.sum("size").alias("used"), F.count("*").alias("pieces"))
    return by.agg(
        F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("used").alias("tokens"),
        (F.sum("used") / (F.count("*") * capacity)).alias("fill"), F.max("used").alias("fullest"),
    )
