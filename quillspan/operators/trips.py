"""Trip measures, per-key statistics and consecutive pairs within sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import micros

HOUR_US, MINUTE_US = 3_600_000_000, 60_000_000


def whole_units(start: str, end: str, unit_us: int) -> Column:
    """Whole units between two timestamps, truncated toward zero."""
    return F.call_function("div", micros(end) - micros(start), F.lit(unit_us))


def great_circle_km(lon1, lat1, lon2, lat2, radius_km: float = 6371.0) -> Column:
    """Haversine distance, cut to whole kilometres."""
    lon1, lat1, lon2, lat2 = (F.col(c) if isinstance(c, str) else c for c in (lon1, lat1, lon2, lat2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return (F.lit(radius_km) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))).cast("int")


def parse_trip_lines(raw: DataFrame, line: str, *keep: str) -> DataFrame:
    """Adds the seven used fields of a comma-separated trip line and ok: false where a time or number can't be read (strictly) or is missing."""
    f = F.split(F.col(line), ",")
    stamp = lambda k: F.try_to_timestamp(F.get(f, F.lit(k)), F.lit("yyyy-MM-dd HH:mm:ss"))
    number = lambda k: F.get(f, F.lit(k)).try_cast("double")
    names = {"license": F.get(f, F.lit(1)), "pickup_time": stamp(5), "dropoff_time": stamp(6), "pickup_lon": number(10), "pickup_lat": number(11), "dropoff_lon": number(12), "dropoff_lat": number(13)}
    p = raw.select(*keep, *[c.alias(n) for n, c in names.items()])
    ok = F.lit(True)
    for n in names:
        ok = ok & F.col(n).isNotNull()
    return p.withColumn("ok", ok)


def sane(trips: DataFrame, max_hours: int = 3, drop_zero: bool = True) -> DataFrame:
    """Trips whose whole hours are at least 0 and below ``max_hours`` and, with ``drop_zero``, neither end of which is at (0, 0)."""
    t = trips.withColumn("hours", whole_units("pickup_time", "dropoff_time", HOUR_US)).where((F.col("hours") >= 0) & (F.col("hours") < max_hours))
    if drop_zero:
        t = t.where("not (pickup_lon = 0 and pickup_lat = 0) and not (dropoff_lon = 0 and dropoff_lat = 0)")
    return t


def iso_weekday(time: str) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(F.col(time)) + 1


def consecutive(trips: DataFrame, key: str, time: str, order_id: str, gap_seconds: int, next_columns: list[str]) -> DataFrame:
    """Every row that has a successor in its session, with the successor's columns as next_<name>.

    A successor lies less than the gap ahead, hence in the same or the next bucket as wide as the gap: windows run within one key's bucket, and only each
    bucket's first row is joined to the bucket before.
    """
    gap = gap_seconds * 1_000_000
    t = trips.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("_t", micros(time)).withColumn("_b", F.expr(f"(_t - pmod(_t, {gap}L)) div {gap}L"))
    row = F.struct(F.col("_t"), F.col(order_id).alias("_i"), *[F.col(c).alias(f"_n_{c}") for c in next_columns])
    w = Window.partitionBy(key, "_b").orderBy("_t", order_id)
    firsts = t.groupBy(key, (F.col("_b") - 1).alias("_b")).agg(F.min(row).alias("_f"))
    j = t.withColumn("_l", F.lead(row).over(w)).join(firsts, [key, "_b"], "left")
    nxt = F.coalesce(F.col("_l"), F.when(F.col("_f._t") - F.col("_t") < gap, F.col("_f")))
    return j.withColumn("_x", nxt).where("_x is not null").select(*trips.columns, *[F.col(f"_x._n_{c}").alias(f"next_{c}") for c in next_columns])


def mean_or_zero(value: Column) -> Column:
    """The mean of the non-null values, 0 if there are none."""
    return F.coalesce(F.avg(value), F.lit(0.0))


def running_stats(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """n, mean, stdev (population), largest, smallest per key."""
    return df.withColumn("_v", value).groupBy(*keys).agg(
        F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("stdev"), F.max("_v").alias("largest"), F.min("_v").alias("smallest")
    )
