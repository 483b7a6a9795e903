"""Implausible readings per source: impossible values, spikes, values outside the hour's fences, rates of change outside theirs, and stuck or constant values.

Mergeable quantile sketches per source and hour of the day are built on the partitions and merged: those of an hour give its fences, those of all hours
together the source's. Where the usual value must be the exact median, the merged sketch gives a narrow bracket, rank counts prove that the median lies in it,
and only the distinct values inside it are ranked, so no task ever holds a hot source's rows. Series (rates of change, stuck values) are found on a
range-partitioned order, each task handing on only its border rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut, join_per_key

#: Sketch size and the half-width in rank of the bracket taken around the median (about ten times the sketch's error).
SKETCH_K, BRACKET = 400, 0.06
#: Width of the fences in interquartile ranges, and the least number of readings that an hour (or a source) needs for fences of its own.
REACH, HOUR_VALUES = 3.0, 8
_INF = float("inf")


@dataclass(frozen=True)
class Measure:
    """name; parts: the value's numeric columns (all must be known); impossible: SQL condition over the parts; spike: from a list of
    (part, median) columns the condition for a spike; fence: whether each part is judged by the fences of its source and hour, and as constant;
    rate: whether each part's change per hour since the source's reading before is judged by such fences too."""

    name: str
    parts: tuple[str, ...]
    impossible: str = "false"
    spike: object = None
    fence: bool = False
    rate: bool = False


def exact_medians(df: DataFrame, source: str, parts: dict[str, Column]) -> DataFrame:
    """source, n_rows, n_<part>, med_<part>: number of rows, number and exact median (mean of the middle two) of the non-null values; checkpointed."""
    names = list(parts)
    c = F.col
    v = df.select(c(source).alias("s"), *[x.cast("double").alias(p) for p, x in parts.items()])
    sketches = v.groupBy("s").agg(F.count("*").alias("n_rows"), *[F.kll_sketch_agg_double(p, SKETCH_K).alias(p) for p in names])

    def quantile(p: str, q: float) -> Column:
        return F.when(F.kll_sketch_get_n_double(p) > 0, F.kll_sketch_get_quantile_double(p, F.lit(q)))

    bounds = [x for p in names for x in (quantile(p, 0.5 - BRACKET).alias(f"lo_{p}"), quantile(p, 0.5 + BRACKET).alias(f"hi_{p}"))]
    bracket = cut(sketches.select("s", "n_rows", *bounds))
    found = [
        x for p in names
        for x in (F.count(p).alias(f"n_{p}"), F.count_if(c(p) < c(f"lo_{p}")).alias(f"below_{p}"), F.count_if(c(p).between(c(f"lo_{p}"), c(f"hi_{p}"))).alias(f"in_{p}"))
    ]
    counts = cut(join_per_key(v, bracket, "s", "n_rows").groupBy("s").agg(*found).join(bracket, "s"))

    # where a sketch missed (its error has a bound in probability only), the bracket opens to all values
    def fine(p: str) -> Column:
        return (c(f"below_{p}") <= F.floor((c(f"n_{p}") - 1) / 2)) & (c(f"below_{p}") + c(f"in_{p}") > F.floor(c(f"n_{p}") / 2))

    def opened(p: str) -> list[Column]:
        return [
            c(f"n_{p}"), F.when(fine(p), c(f"lo_{p}")).otherwise(-_INF).alias(f"lo_{p}"), F.when(fine(p), c(f"hi_{p}")).otherwise(_INF).alias(f"hi_{p}"),
            F.when(fine(p), c(f"below_{p}")).otherwise(0).alias(f"below_{p}"),
        ]

    def candidate(p: str) -> Column:
        value = F.struct(F.lit(p).alias("p"), c(p).alias("x"), c(f"below_{p}").alias("below"), c(f"n_{p}").alias("n"))
        return F.when(c(p).isNotNull() & c(p).between(c(f"lo_{p}"), c(f"hi_{p}")), value)

    ranges = cut(counts.select("s", "n_rows", *[x for p in names for x in opened(p)]))
    inside = join_per_key(v, ranges, "s", "n_rows").select("s", F.explode(F.array_compact(F.array(*map(candidate, names)))).alias("r")).select("s", "r.*")
    inside = inside.groupBy("s", "p", "x", "below", "n").agg(F.count("*").alias("c"))
    upto = c("below") + F.sum("c").over(Window.partitionBy("s", "p").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lower, upper = F.floor((c("n") - 1) / 2), F.floor(c("n") / 2)  # ranks from 0
    holds = lambda k: (c("upto") > k) & (c("upto") - c("c") <= k)
    mid = inside.withColumn("upto", upto).where(holds(lower) | holds(upper)).groupBy("s", "p").agg(((F.min("x") + F.max("x")) / 2).alias("m"))
    mid = mid.groupBy("s").agg(*[F.max(F.when(c("p") == p, c("m"))).alias(f"med_{p}") for p in names])
    return cut(counts.select("s", "n_rows", *[f"n_{p}" for p in names]).join(mid, "s", "left")).withColumnRenamed("s", source)


def context_fences(df: DataFrame, source: str, hour: str, values: list[str], reach: float = REACH, min_values: int = HOUR_VALUES) -> DataFrame:
    """source, n_rows, whole, hours: one row per source; checkpointed. ``whole`` holds low_<value>, high_<value> and flat_<value>: the fences
    [q1 - reach x iqr, q3 + reach x iqr] of all the source's readings and whether they never vary; ``hours`` maps each hour to the same of its readings alone.
    ``hour`` must not be null.

    The quartiles come from sketches merged across partitions (rank error below one percent, none up to SKETCH_K values). What has fewer than
    ``min_values`` values has null fences; hours without any of their own are left out.
    """
    sketches = [F.kll_sketch_agg_double(F.col(x).cast("double"), SKETCH_K).alias(x) for x in values]
    hours = df.groupBy(F.col(source).alias("s"), F.col(hour).alias("h")).agg(F.count("*").alias("n"), *sketches)

    def facts(x: str) -> list[Column]:
        n = F.kll_sketch_get_n_double(x)
        lo, q1, q3, hi = (F.when(n >= min_values, F.kll_sketch_get_quantile_double(x, F.lit(r))) for r in (0.0, 0.25, 0.75, 1.0))
        return [(q1 - reach * (q3 - q1)).alias(f"low_{x}"), (q3 + reach * (q3 - q1)).alias(f"high_{x}"), (lo == hi).alias(f"flat_{x}")]

    own = F.when(F.col("n") >= min_values, F.struct("h", F.struct(*[f for x in values for f in facts(x)]).alias("f")))
    per = hours.select("s", "n", own.alias("own"), *values).groupBy("s").agg(  # at most 25 hours per source
        F.sum("n").alias("n_rows"), F.map_from_entries(F.collect_list("own")).alias("hours"), *[F.kll_merge_agg_double(x).alias(x) for x in values]
    )
    return cut(per.select(F.col("s").alias(source), "n_rows", F.struct(*[f for x in values for f in facts(x)]).alias("whole"), "hours"))


def with_fences(df: DataFrame, source: str, hour: str, values: list[str], reach: float = REACH, min_values: int = HOUR_VALUES) -> DataFrame:
    """Adds low_<value>, high_<value> and flat_<value> to the readings of known sources: of their hour where it has enough values, else of their source, else null."""
    j = join_per_key(df, context_fences(df, source, hour, values, reach, min_values), source, "n_rows").withColumn("_own", F.try_element_at("hours", F.col(hour)))
    names = [f"{name}_{x}" for x in values for name in ("low", "high", "flat")]
    return j.select(*df.columns, *[F.coalesce(F.col(f"_own.{n}"), F.col(f"whole.{n}")).alias(n) for n in names])


def with_rates(df: DataFrame, source: str, time: str, order_id: str, parts: list[str]) -> DataFrame:
    """Adds rate_<part>: the change per hour since the source's reading before, in the order (time, order_id); ``time`` is in microseconds.

    Null for a source's first reading, for one without source or time, and where either value is unknown or no time has passed. The readings are sorted within
    range partitions; of each partition only the last reading is seen by another one.
    """
    columns = df.columns
    at = {c: k for k, c in enumerate(columns)}
    spread = df.repartitionByRange(F.col(source).asc(), F.col(time).asc(), F.col(order_id).asc())
    placed = cut(spread.sortWithinPartitions(source, time, order_id).withColumn("_part", F.spark_partition_id()))
    last = F.struct(F.col(source).alias("s"), F.col(time).cast("bigint").alias("t"), *[F.col(p).cast("double").alias(f"p{k}") for k, p in enumerate(parts)])
    order = F.struct(source, time, order_id)
    ends = sorted((r[0], tuple(r[1])) for r in placed.groupBy("_part").agg(F.max_by(last, order)).collect())  # one row per partition
    before = {part: end for (part, _), (_, end) in zip(ends[1:], ends)}
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"rate_{p}", T.DoubleType()) for p in parts]])
    floats = lambda b, c, kind: pc.cast(b.column(at[c]), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # source, time and values of the row before
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            held = before.get(b.column(len(columns))[0].as_py()) if held is None else held
            s, t, x = b.column(at[source]), floats(b, time, pa.int64()), [floats(b, p, pa.float64()) for p in parts]
            same = np.r_[held is not None and s[0].as_py() is not None and s[0].as_py() == held[0], pc.fill_null(pc.equal(s.slice(1), s.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)]
            shift = lambda v, first, kind: np.r_[np.nan if first is None else first, v.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)[:-1]]
            us = t.to_numpy(zero_copy_only=False).astype(float)  # null as NaN; microseconds of this age are exact
            hours = (us - shift(t, held and held[1], float)) / 3.6e9
            ok = same & (hours > 0)
            rates = []
            for k, v in enumerate(x):
                now = v.to_numpy(zero_copy_only=False)
                with np.errstate(invalid="ignore", divide="ignore"):
                    rate = (now - shift(v, held and held[2 + k], float)) / hours
                rates.append(pa.array(rate, pa.float64(), mask=~ok | np.isnan(rate)))
            held = (s[n - 1].as_py(), t[n - 1].as_py(), *(v[n - 1].as_py() for v in x))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], *rates], schema.names)

    return placed.mapInArrow(run, schema)


def stuck_runs(df: DataFrame, source: str, time: str, order_id: str, marks: list[str], at_least: int = 5, partitions: int | None = None) -> DataFrame:
    """order_id, mark: rows within ``at_least`` or more consecutive rows of one source with the same non-null value of the column ``mark``.

    Rows with a null mark are passed over; order is (time, order_id). Every column of ``marks`` must be a bigint (a hash of the value will do).
    """
    need = at_least - 1
    series = [F.col(m).cast("bigint").alias(f"m{k}") for k, m in enumerate(marks)]
    d = df.select(F.col(source).alias("s"), F.col(time).cast("bigint").alias("t"), F.col(order_id).cast("bigint").alias("i"), *series)
    d = d.where(" or ".join(f"m{k} is not null" for k in range(len(marks))))
    spread = d.repartitionByRange(*([partitions] if partitions else []), "s", "t", "i")
    ordered = spread.withColumn("part", F.spark_partition_id()).withColumn("h", F.xxhash64("s")).sortWithinPartitions("s", "t", "i").select("part", "h", "i", *[f"m{k}" for k in range(len(marks))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # per mark: the last rows seen that are not settled yet, as (h, value, id, row number)
        held = [np.empty((0, 4), np.int64) for _ in marks]
        seen = [0] * len(marks)
        tails = [np.empty((0, 4), np.int64) for _ in marks]
        told = [set() for _ in marks]
        part = None

        def out(k: int, rows: np.ndarray, edge: bool) -> pa.RecordBatch:
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([k] * n, pa.int32()), pa.array(rows[:, 2]), pa.array([edge] * n, pa.bool_()), pa.array([part] * n, pa.int32()), pa.array(rows[:, 3]), pa.array(rows[:, 0]), pa.array(rows[:, 1])],
                ["mark", "i", "edge", "part", "pos", "h", "v"],
            )

        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(0)[0].as_py()
            h, i = b.column(1).to_numpy(), b.column(2).to_numpy()
            for k in range(len(marks)):
                m = b.column(3 + k)
                at = np.flatnonzero(m.is_valid().to_numpy(zero_copy_only=False))
                fresh = np.stack([h[at], m.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[at], i[at], seen[k] + np.arange(len(at))], axis=1)
                seen[k] += len(at)
                rows = np.concatenate([held[k], fresh])
                if not len(rows):
                    continue
                new = np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])]
                run = np.cumsum(new) - 1
                hit = np.bincount(run)[run] >= at_least
                hit &= ~np.isin(rows[:, 3], list(told[k]))
                if hit.any():
                    yield out(k, rows[hit], False)
                head = fresh[fresh[:, 3] < need]
                if len(head):
                    yield out(k, head, True)
                # a run that goes on needs its last rows: as many as decide it, marked if already told
                last = rows[run == run[-1]][-at_least:]
                told[k] = set(last[:, 3].tolist()) & (told[k] | set(rows[hit, 3].tolist()))
                held[k] = last
                tails[k] = np.concatenate([tails[k], fresh])[-need:]
        for k in range(len(marks)):
            tail = tails[k][tails[k][:, 3] >= need]
            if len(tail):
                yield out(k, tail, True)

    found = cut(ordered.mapInArrow(find, "mark int, i bigint, edge boolean, part int, pos bigint, h bigint, v bigint"))
    # border rows: at most 2 x need rows per partition and mark; a row number that jumps within a partition breaks a run
    w = Window.partitionBy("mark").orderBy("part", "pos")
    same = (F.col("h") == F.lag("h").over(w)) & (F.col("v") == F.lag("v").over(w)) & ((F.col("part") != F.lag("part").over(w)) | (F.col("pos") == F.lag("pos").over(w) + 1))
    edges = found.where("edge").withColumn("new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    crossing = edges.withColumn("len", F.count("*").over(Window.partitionBy("mark", "run"))).where(F.col("len") >= at_least)
    hits = found.where("not edge").select("mark", "i").union(crossing.select("mark", "i")).distinct()
    return hits.select(F.col("i").alias(order_id), F.element_at(F.array(*map(F.lit, marks)), F.col("mark") + 1).alias("mark"))


def implausible(
    df: DataFrame, source: str, time: str, order_id: str, measures: list[Measure], min_values: int = 20, stuck_at: int = 5, hour: str | None = None, reach: float = REACH,
    hour_values: int = HOUR_VALUES,
) -> DataFrame:
    """order_id, field_name, kind: readings with the first of these kinds that their measure asks for and that holds.

    - ``impossible``: the measure's condition.
    - ``spike``: against the source's exact median, for parts with at least ``min_values`` readings.
    - ``outside``: a part is outside the fences of its source in its hour of the day (see ``context_fences``; ``hour`` is the column, null being an hour of its own).
    - ``jump``: a part's change per hour since the source's reading before is outside the fences of such rates.
    - ``constant``: a part never varies in its source and hour, although there are at least ``hour_values`` readings.
    - ``stuck``: one of ``stuck_at`` or more equal readings in a row among the source's remaining ones.

    ``df`` holds each reading once, ``time`` as a bigint of microseconds. Readings without source are left out, those without time have no rate and never
    count as stuck, and a measure with an unknown part has no reading. Ties in time are ordered by order_id. Columns beyond those used are ignored; an
    empty input gives no rows.
    """
    used = [source, time, order_id, *dict.fromkeys(p for m in measures for p in m.parts if p not in (source, time, order_id))]
    hours = [F.coalesce(F.col(hour).cast("int"), F.lit(-1)).alias("_hour")] if hour else []
    df = df.where(F.col(source).isNotNull()).select(*used, *hours)
    known = {m.name: F.lit(True) for m in measures}
    for m in measures:
        for p in m.parts:
            known[m.name] = known[m.name] & F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double"))
    values = {p: F.when(known[m.name], F.col(p)) for m in measures for p in m.parts}
    fenced = [p for m in measures if m.fence for p in m.parts]
    rated = [p for m in measures if m.rate for p in m.parts]
    if (fenced or rated) and not hour:
        raise ValueError("fences need the column of the hour")
    # what made the readings unique is done once, the sketches, the rank counts, the ranking and the judging each pass over them
    if rated:
        told = df.select(*df.columns, *[values[p].cast("double").alias(f"_v_{p}") for p in rated])
        df = with_rates(told, source, time, order_id, [f"_v_{p}" for p in rated]).drop(*[f"_v_{p}" for p in rated]).withColumnsRenamed({f"rate__v_{p}": f"rate_{p}" for p in rated})
    else:
        df = cut(df)
    j = df
    if fenced or rated:
        judged = df.withColumns({f"_v_{p}": values[p].cast("double") for p in dict.fromkeys(fenced)})
        fences = [*(f"_v_{p}" for p in fenced), *(f"rate_{p}" for p in rated)]
        j = with_fences(judged, source, "_hour", fences, reach, hour_values)
    if any(m.spike for m in measures):
        j = join_per_key(j, exact_medians(df, source, {p: v for p, v in values.items() if any(m.spike and p in m.parts for m in measures)}), source, "n_rows")

    def beyond(x: str) -> Column:
        return F.coalesce((F.col(x) < F.col(f"low_{x}")) | (F.col(x) > F.col(f"high_{x}")), F.lit(False))

    def any_of(conditions: list[Column]) -> Column:
        out = F.lit(False)
        for x in conditions:
            out = out | x
        return out

    kinds = []
    for m in measures:
        kind = F.when(~known[m.name], None).when(F.expr(m.impossible), "impossible")
        if m.spike:
            usual = [(F.col(p), F.when(F.col(f"n_{p}") >= min_values, F.col(f"med_{p}"))) for p in m.parts]
            kind = kind.when(F.coalesce(m.spike(usual), F.lit(False)), "spike")
        if m.fence:
            kind = kind.when(any_of([beyond(f"_v_{p}") for p in m.parts]), "outside")
        if m.rate:
            kind = kind.when(any_of([beyond(f"rate_{p}") for p in m.parts]), "jump")
        if m.fence:
            kind = kind.when(any_of([F.coalesce(f"flat__v_{p}", F.lit(False)) for p in m.parts]), "constant")
        kinds.append(kind.otherwise("").alias(f"_k_{m.name}"))
    judged = j.select(source, time, order_id, *[F.xxhash64(*m.parts).alias(f"_h_{m.name}") for m in measures], *kinds)
    judged = cut(judged) if fenced or rated else judged  # it is read twice
    far = F.array(*[F.when(F.col(f"_k_{m.name}") != "", F.struct(F.lit(m.name).alias("field_name"), F.col(f"_k_{m.name}").alias("kind"))) for m in measures])
    out = judged.select(order_id, F.explode(F.array_compact(far)).alias("r")).select(order_id, "r.*")
    marks = [F.when(F.col(f"_k_{m.name}") == "", F.col(f"_h_{m.name}")).alias(m.name) for m in measures]
    rest = judged.where(F.col(time).isNotNull()).select(source, time, order_id, *marks)
    stuck = stuck_runs(rest, source, time, order_id, [m.name for m in measures], stuck_at)
    return out.unionByName(stuck.select(order_id, F.col("mark").alias("field_name"), F.lit("stuck").alias("kind")))


def hourly_fences(df: DataFrame, source: str, hour: str, order_id: str, value: str, reach: float = REACH, min_values: int = HOUR_VALUES) -> DataFrame:
    """order_id, low, high, kind: readings outside the fences of their source in their hour of the day (``outside``), or whose source and hour never vary
    (``constant``), by ``context_fences``. Null sources or values are left out; a null hour is an hour of its own."""
    d = df.select(F.col(source).alias("s"), F.coalesce(F.col(hour).cast("int"), F.lit(-1)).alias("h"), F.col(order_id).alias("i"), F.col(value).cast("double").alias("x"))
    d = d.where("s is not null and x is not null and not isnan(x)")
    j = with_fences(d, "s", "h", ["x"], reach, min_values)
    kind = F.when(F.col("flat_x"), "constant").when((F.col("x") < F.col("low_x")) | (F.col("x") > F.col("high_x")), "outside")
    return j.select(F.col("i").alias(order_id), F.col("low_x").alias("low"), F.col("high_x").alias("high"), kind.alias("kind")).where("kind is not null")
