"""Gap-based sessions by start-end pairing.

Events are first folded into buckets as wide as the gap: two events of one bucket are always closer than the gap, so a bucket never
spans two sessions and hot keys shrink to at most (time span / gap) rows before any window runs. RANGE frames of one bucket to either
side then find the buckets without a near predecessor (session starts) or successor (session ends); starts and ends are numbered
separately and joined on equal rank; the number of events is the difference of the running event ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, micros

#: Buckets per window group: a key with a long history is spread over several tasks, each seeing one bucket of its neighbours.
BLOCK = 4096


def gap_sessions(events: DataFrame, key: str, time: str, order_id: str, gap_seconds: int, end_time: str | None = None, block: int = BLOCK) -> DataFrame:
    """One row per session: key, session (from 1 within the key), first_id, last_id, start, end, duration_s, n_events.

    A session begins where the event is ``gap_seconds`` or more after the key's previous one, events being ordered by (time, order_id).
    ``end`` is ``end_time`` of the last event, or its ``time`` where that is null or not given; it may lie before the start if the input does.
    Rows with a null key or time belong to no session. Repeated rows (equal in all columns used) count once; ties in time are ordered by
    order_id (nulls first). An empty input gives no rows. Other columns of the input are ignored, whatever their names.
    """
    gap = gap_seconds * 1_000_000
    e = (
        events.select(F.col(key).alias("k"), micros(time).alias("t"), F.col(order_id).alias("i"), micros(end_time or time).alias("e"))
        .where("k is not null and t is not null")
        .distinct()
    )
    buckets = (
        e.groupBy("k", F.expr(f"(t - pmod(t, {gap}L)) div {gap}L").alias("b"))
        .agg(F.min(F.struct("t", "i")).alias("lo"), F.max(F.struct("t", "i", "e")).alias("hi"), F.count("*").alias("n"))
    )
    # Bucket at a block's edge: also shown to the neighbouring block, where it serves only as a neighbour.
    place = F.pmod(F.col("b"), F.lit(block))
    shown = buckets.withColumn("off", F.explode(F.array_compact(F.array(F.lit(0), F.when(place == 0, -1), F.when(place == block - 1, 1))))).withColumn(
        "blk", F.expr(f"(b - pmod(b, {block}L)) div {block}L") + F.col("off")
    )
    w = Window.partitionBy("k", "blk").orderBy("b")
    near_before = F.max("hi.t").over(w.rangeBetween(-1, -1))
    near_after = F.min("lo.t").over(w.rangeBetween(1, 1))
    marked = (
        shown.withColumn("starts", F.coalesce(F.col("lo.t") - near_before >= gap, F.lit(True)).cast("int"))
        .withColumn("ends", F.coalesce(near_after - F.col("hi.t") >= gap, F.lit(True)).cast("int"))
        .where("off = 0")
    )
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        marked.withColumn("s_rank", F.sum("starts").over(upto))
        .withColumn("e_rank", F.sum("ends").over(upto))
        .withColumn("n_upto", F.sum("n").over(upto))
        .withColumn("last", F.lead("b").over(w).isNull())
        .where("starts = 1 or ends = 1 or last")
        .select("k", "blk", "starts", "ends", "last", "s_rank", "e_rank", "n_upto", "n", "lo", "hi")
    )
    ranked = cut(ranked)
    # The last bucket of each block holds the block's totals; their running sums make the ranks hold over the whole key.
    before = Window.partitionBy("k").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranked.where("last").select(
        "k", "blk", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("s_rank", "e_rank", "n_upto")]
    )
    full = ranked.join(offsets, ["k", "blk"])
    starts = full.where("starts = 1").select("k", (F.col("s_rank") + F.col("s_rank0")).alias("r"), "lo", (F.col("n_upto") + F.col("n_upto0") - F.col("n")).alias("n_before"))
    ends = full.where("ends = 1").select("k", (F.col("e_rank") + F.col("e_rank0")).alias("r"), "hi", (F.col("n_upto") + F.col("n_upto0")).alias("n_through"))
    end_us = F.coalesce(F.col("hi.e"), F.col("hi.t"))
    return starts.join(ends, ["k", "r"]).select(
        F.col("k").alias(key), F.col("r").alias("session"), F.col("lo.i").alias("first_id"), F.col("hi.i").alias("last_id"),
        F.timestamp_micros(F.col("lo.t")).alias("start"), F.timestamp_micros(end_us).alias("end"),
        ((end_us - F.col("lo.t")) / 1e6).alias("duration_s"), (F.col("n_through") - F.col("n_before")).alias("n_events"),
    )
