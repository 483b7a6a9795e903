"""Filling containers of fixed capacity with items: hierarchical residual packing.

The items are dealt into groups of bounded size, each of which is packed by best fit, largest first. A container is final once it is nearly
full or nothing that remains could fit into it; only the others travel on, as items of the next level, where they are dealt into groups of
the same bound. The tree ends when one group held all that remained, or when a level no longer saves containers. A container travels as one
row (its number and size): which items it holds is told by the levels' assignments, joined at the end.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, small_or_plain

#: Most rows of any group; the fill from which a container is final; the least part of the containers that a level must save for another one to follow.
GROUP_ITEMS, FULL, LEAST_SAVED = 4_096, 0.995, 0.005


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers: each item, largest first, goes to the fullest bin it fits in."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free space, bin), sorted
    for k in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[k], -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(k)
        else:
            free, b = capacity, len(bins)
            bins.append([k])
        if free > sizes[k]:
            insort(room, (free - sizes[k], b))
    return bins


def pieces_of(data: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(piece, start, size) of an item in bytes; cut only if it alone exceeds the capacity, and not inside a character."""
    out, a = [], 0
    while a < len(data):
        b = min(a + capacity, len(data))
        while b < len(data) and b > a + 1 and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append((len(out), a, b - a))
        a = b
    return out


def _deal(df: DataFrame, group_rows: int) -> tuple[DataFrame, int, int]:
    """Adds ``b``, a number from 0 without gaps, and ``g``, the group: every group holds at most ``group_rows`` rows, spread over the whole input.

    ``df`` must be read from a checkpoint, so that its partitions are the same each time.
    """
    spark = df.sparkSession
    counts = sorted((r[0], r[1]) for r in df.groupBy(F.spark_partition_id()).count().collect())  # one row per partition
    first = np.cumsum([0, *(n for _, n in counts)])
    groups = max(1, -(-int(first[-1]) // group_rows))
    offsets = spark.createDataFrame([(p, int(o)) for (p, _), o in zip(counts, first)], "_p int, _o bigint")
    numbered = df.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    dealt = numbered.join(F.broadcast(offsets), "_p").withColumn("b", F.col("_m") + F.col("_o")).drop("_p", "_m", "_o")
    return dealt.withColumn("g", F.col("b") % groups), int(first[-1]), groups


def _filler(capacity: int, level: int, group_rows: int, keep: list[str]):
    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by("b")
        if t.num_rows > group_rows:
            raise ValueError("a group is larger than its bound")
        sizes = t.column("size").to_pylist()
        bins, at, held = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        base = (level << 56) + t.column("g")[0].as_py() * group_rows
        for no, chosen in enumerate(best_fit(sizes, capacity)):
            ends = np.cumsum([sizes[k] for k in chosen])
            bins[chosen], at[chosen], held[chosen] = base + no, ends - [sizes[k] for k in chosen], ends[-1]
        return pa.table([*[t.column(c) for c in keep], pa.array(bins), pa.array(at), pa.array(held)], [*keep, "bin", "at", "held"])

    return fill


def pack(df: DataFrame, item: str, text: str, capacity: int, group_items: int = GROUP_ITEMS, full: float = FULL) -> DataFrame:
    """container, item, piece, start_token, n_tokens, at: the place of every item (and of every piece of an item over the capacity).

    Sizes are bytes of UTF-8. ``at`` is the offset in the container; pieces of an oversized item are as long as the capacity allows without
    cutting a character, the last one is packed like an item. Items that are null or empty need no room: they come out once with a
    null container. Ids are taken as they come (a repeated id is packed each time); an item with a null id is packed under it. Items of equal
    size are taken in the order of the input, so the same input in the same partitions packs alike. Other columns are ignored.
    """
    src = df.select(F.col(item).cast("bigint").alias("id"), F.col(text).alias("t"), F.octet_length(text).alias("size"))

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *p) for k, t in enumerate(b.column(1)) for p in pieces_of(t.as_py().encode(), capacity)]
            cols = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), pa.array(cols[2]), pa.array(cols[3].astype(np.int32))], ["id", "piece", "start", "size"]
            )

    whole = src.where(F.col("size").between(1, capacity)).select("id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), "size")
    items = cut(whole.unionByName(src.where(F.col("size") > capacity).select("id", "t").mapInArrow(divide, "id bigint, piece int, start bigint, size int")))
    now, count, groups = _deal(items, group_items)
    assigned: list[DataFrame] = []
    while True:
        level = len(assigned)
        keep, types = (["id", "piece", "start", "size"], "id bigint, piece int, start bigint, size int") if level == 0 else (["b"], "b bigint")
        assigned.append(cut(now.groupBy("g").applyInArrow(_filler(capacity, level, group_items, keep), f"{types}, bin bigint, at bigint, held bigint")))
        if groups == 1:
            break
        # the first item of a bin stands for it
        bins = assigned[-1].where("at = 0").select(F.col("bin").alias("b"), F.col("held").cast("int").alias("size"))
        open_bins = bins.where(F.col("size") < full * capacity)
        made, least = bins.count(), open_bins.agg(F.min("size")).first()[0]
        if least is None or (level and count - made < LEAST_SAVED * count):
            break
        # what the least of them doesn't fit into is final
        left = open_bins.where(F.col("size") <= capacity - least).withColumnRenamed("b", "old")
        dealt, count, groups = _deal(left, group_items)
        if count < 2:
            break
        now = dealt.drop("b").withColumnRenamed("old", "b")
    place = None  # of the bins of the level below: b, container, at
    for k in range(len(assigned) - 1, -1, -1):
        a = assigned[k]
        if place is None:
            a = a.withColumn("container", F.col("bin"))
        else:
            up = small_or_plain(cut(place.select(F.col("b").alias("bin"), F.col("container").alias("_c"), F.col("at").alias("_a"))))
            a = a.join(up, "bin", "left").withColumn("container", F.coalesce("_c", "bin")).withColumn("at", F.col("at") + F.coalesce("_a", F.lit(0)))
        place = a
    placed = place.select(
        F.col("container").cast("string").alias("container"), F.col("id").alias(item), "piece", F.col("start").alias("start_token"), F.col("size").cast("bigint").alias("n_tokens"), "at"
    )
    zero = F.lit(0).cast("bigint")
    nothing = src.where("size is null or size = 0").select(
        F.lit(None).cast("string").alias("container"), F.col("id").alias(item), F.lit(0).alias("piece"), zero.alias("start_token"), zero.alias("n_tokens"), zero.alias("at")
    )
    return placed.unionByName(nothing)
