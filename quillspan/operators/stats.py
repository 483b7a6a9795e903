"""Correlations, distributed ranks and threshold metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import BROADCAST_BYTES, cut, join_per_key

#: Bytes of a value's rank in a broadcast.
RANK_BYTES = 64


def running_totals(df: DataFrame, order: str, sums: list[str], descending: bool = False) -> DataFrame:
    """Adds upto_<c> (sum of c over all rows up to this one, itself included) and all_<c> (over all rows) in the order of the column ``order``, which holds no
    value twice. The rows are range-partitioned, summed within their partition and shifted by the totals of the partitions before: no task orders them all."""
    by = F.desc(order) if descending else F.asc(order)
    parts = cut(df.repartitionByRange(by).withColumn("_part", F.spark_partition_id()))
    before, every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    totals = parts.groupBy("_part").agg(*[F.sum(c).alias(c) for c in sums])  # one row per partition
    first = totals.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_first_{c}") for c in sums], *[F.sum(c).over(every).alias(f"all_{c}") for c in sums])
    upto = Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = parts.join(F.broadcast(first), "_part")
    return j.select(*df.columns, *[(F.col(f"_first_{c}") + F.sum(c).over(upto)).alias(f"upto_{c}") for c in sums], *[f"all_{c}" for c in sums])


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """value, n, rank: how often each distinct non-null value occurs and its average rank, without ordering the rows in one task."""
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return running_totals(counted, "value", ["n"]).select("value", "n", (F.col("upto_n") - (F.col("n") - 1) / 2).alias("rank"))


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for every pair a < b in the order given, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]).alias("c"))
    return one.select(F.explode("c").alias("c")).select("c.*")


def spearman(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """column, rho: rank correlation of each numeric column with the label over the rows in which all columns are known; constant columns give null.

    All columns are ranked together, as one order of (column, value), since every column has as many values as there are rows. A column's ranks (one row per
    distinct value) are broadcast if proven small; of larger ones only those of values that a large part of the rows hold, so that no shuffled task meets
    more than a bounded number of rows with one value.
    """
    names = [label, *columns]
    # rows are left out after the checkpoint: a condition pushed below it would work out every column again
    d = cut(df.select(*[F.col(c).cast("double").alias(c) for c in names])).dropna()
    rows = d.count()
    long = d.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).alias("v")) for i, c in enumerate(names)])).alias("k"))
    ordered = running_totals(long.groupBy("k").agg(F.count("*").alias("n")), "k", ["n"])
    ranks = cut(ordered.select("k.c", "k.v", "n", (F.col("upto_n") - F.col("k.c") * F.lit(rows) - (F.col("n") - 1) / 2).alias("rank")))
    distinct = {r["c"]: r["count"] for r in ranks.groupBy("c").count().collect()}  # one row per column
    for i, c in enumerate(names):
        r = ranks.where(F.col("c") == i).select(F.col("v").alias(c), F.col("n").alias("_n"), F.col("rank").alias(f"_r_{c}"))
        d = (d.join(F.broadcast(r), c) if distinct.get(i, 0) * RANK_BYTES <= BROADCAST_BYTES else join_per_key(d, r, c, "_n")).drop("_n")
    one = d.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.corr(f"_r_{label}", f"_r_{c}").alias("rho")) for c in columns]).alias("c"))
    return one.select(F.explode("c").alias("c")).select("c.*")


def _ratio(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def _curve(scored: DataFrame, score: str, label: str) -> DataFrame:
    """threshold, p, n, upto_p, upto_n, all_p, all_n: positive and negative labels at each distinct score, at or above it, and in all."""
    at = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold"))
    by = at.agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.sum(1 - F.col(label).cast("bigint")).alias("n"))
    return running_totals(by, "threshold", ["p", "n"], descending=True)


def threshold_metrics(scored: DataFrame, score: str, label: str) -> DataFrame:
    """threshold, tp, fp, precision, recall, fpr: one row per distinct score, positives being the rows at or above it. Null scores are left out."""
    tp, fp = F.col("upto_p"), F.col("upto_n")
    precision, recall, fpr = _ratio(tp, tp + fp), _ratio(tp, F.col("all_p")), _ratio(fp, F.col("all_n"))
    return _curve(scored, score, label).select("threshold", tp.alias("tp"), fp.alias("fp"), precision.alias("precision"), recall.alias("recall"), fpr.alias("fpr"))


def ranking_metrics(scored: DataFrame, score: str, label: str) -> DataFrame:
    """auroc, aupr: areas by trapezoids; the precision-recall curve starts at recall 0 with the first precision.

    The point before each threshold follows from the counts at it, so the areas are plain sums over the thresholds.
    """
    tp, fp, all_p, all_n = (F.col(c).cast("double") for c in ("upto_p", "upto_n", "all_p", "all_n"))
    tp0, fp0 = tp - F.col("p"), fp - F.col("n")
    roc = (_ratio(fp, all_n) - _ratio(fp0, all_n)) * (_ratio(tp, all_p) + _ratio(tp0, all_p)) / 2
    first = F.when(tp0 + fp0 == 0, _ratio(tp, tp + fp)).otherwise(_ratio(tp0, tp0 + fp0))
    pr = (_ratio(tp, all_p) - _ratio(tp0, all_p)) * (_ratio(tp, tp + fp) + first) / 2
    return _curve(scored, score, label).agg(F.sum(roc).alias("auroc"), F.sum(pr).alias("aupr"))
