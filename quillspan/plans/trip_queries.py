"""Queries over trips, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trips as T
from ..operators.spatial import match_points, region_facts, region_triangles
from ..runtime import cut, small_or_plain, table
from .problems import GAP_H


def _trips(spark: SparkSession, sf: str) -> DataFrame:
    """Each trip once."""
    return table(spark, sf, "trips").drop("received_at").distinct()


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    return T.sane(_trips(spark, sf))


def with_borough(spark: SparkSession, sf: str, trips: DataFrame) -> DataFrame:
    """Adds boroughcode of the drop-off, null if no borough holds it."""
    regions = region_triangles(table(spark, sf, "boroughs"), "boroughcode", "geojson")
    return match_points(trips, trips.columns, "dropoff_lon", "dropoff_lat", regions, outer=True).drop("kind").withColumnRenamed("target_id", "boroughcode")


_HALF = "pickup_lon = dropoff_lon and pickup_lat = dropoff_lat"


def trips_parse_good_bad(spark: SparkSession, sf: str) -> DataFrame:
    p = T.parse_trip_lines(table(spark, sf, "raw_trips"), "raw_line", "line_id")
    return p.groupBy("ok").agg(F.count("*").alias("cnt"))


def trip_hours_hist(spark: SparkSession, sf: str) -> DataFrame:
    h = _trips(spark, sf).withColumn("hours", T.whole_units("pickup_time", "dropoff_time", T.HOUR_US)).where("hours is not null")
    return h.groupBy("hours").agg(F.count("*").alias("cnt")).orderBy("hours")


def trip_stats_diff_eq(spark: SparkSession, sf: str) -> DataFrame:
    t = _clean(spark, sf).where("pickup_lon is not null and dropoff_lon is not null")
    return t.groupBy(F.expr(_HALF).alias("same_location")).agg(F.count("*").alias("n"), F.sum("hours").alias("sum_hours"), F.avg("hours").alias("mean_hours"))


def trips_per_borough(spark: SparkSession, sf: str) -> DataFrame:
    t = with_borough(spark, sf, T.sane(_trips(spark, sf), drop_zero=False))
    return t.groupBy("boroughcode").agg(F.count("*").alias("n"))


def trips_per_feature(spark: SparkSession, sf: str) -> DataFrame:
    """feature_id, n: each drop-off counts for the feature that holds it, of several for the one of the lowest borough code and then the greatest area."""
    b = table(spark, sf, "boroughs")
    t = T.sane(_trips(spark, sf), drop_zero=False)
    hits = match_points(t, ["trip_id"], "dropoff_lon", "dropoff_lat", region_triangles(b, "feature_id", "geojson"), first_region=False)
    order = b.select("feature_id", "boroughcode").join(region_facts(b, "feature_id", "geojson"), "feature_id")
    best = F.struct("boroughcode", (-F.col("area")).alias("area"), "feature_id")
    f = hits.join(small_or_plain(cut(order)), hits.target_id == order.feature_id)
    return f.groupBy("trip_id").agg(F.min(best).alias("f")).groupBy("f.feature_id").agg(F.count("*").alias("n"))


def trip_sum_avg_by_region(spark: SparkSession, sf: str) -> DataFrame:
    t = with_borough(spark, sf, _clean(spark, sf))
    return t.groupBy("boroughcode").agg(F.sum("hours").alias("sum_hours"), T.mean_or_zero(F.col("hours")).alias("mean_hours"), F.count("*").alias("n"))


def trip_sum_avg_by_dow(spark: SparkSession, sf: str) -> DataFrame:
    return _clean(spark, sf).groupBy(T.iso_weekday("pickup_time").alias("dow")).agg(F.sum("hours").alias("sum_hours"), F.avg("hours").alias("mean_hours"))


def trip_group_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    """Number of groups, the one without borough included."""
    keys = trips_per_borough(spark, sf).select("boroughcode").distinct()
    return keys.agg(F.count("*").alias("n_groups"))


def trip_busiest(spark: SparkSession, sf: str) -> DataFrame:
    """The weekday with most hours, the later one of equals."""
    return trip_sum_avg_by_dow(spark, sf).agg(F.max_by("dow", F.struct("sum_hours", "dow")).alias("dow"), F.max("sum_hours").alias("sum_hours"))


def haversine_norm_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    t = _clean(spark, sf).where("pickup_lon is not null and dropoff_lon is not null")
    km = T.great_circle_km("pickup_lon", "pickup_lat", "dropoff_lon", "dropoff_lat")
    t = t.select(F.hour("pickup_time").alias("hour"), T.whole_units("pickup_time", "dropoff_time", T.MINUTE_US).alias("mins"), km.alias("km"))
    norm = F.when(F.col("km") == 0, F.col("mins").cast("double")).otherwise(F.col("mins") / F.col("km"))
    return t.groupBy("hour").agg(F.avg(norm).alias("mins_per_km"), F.count("*").alias("n")).orderBy(F.desc("hour"))


def _waits(spark: SparkSession, sf: str) -> DataFrame:
    return T.consecutive(_clean(spark, sf), "license", "pickup_time", "trip_id", GAP_H * 3600, ["pickup_time"])


def trip_wait_hist(spark: SparkSession, sf: str) -> DataFrame:
    w = _waits(spark, sf).select(T.whole_units("dropoff_time", "next_pickup_time", T.HOUR_US).alias("hours"))
    return w.groupBy("hours").agg(F.count("*").alias("cnt")).orderBy("hours")


def _wait_stats(spark: SparkSession, sf: str, keys: list[str]) -> DataFrame:
    w = with_borough(spark, sf, _waits(spark, sf))
    seconds = (F.unix_micros(F.col("next_pickup_time").cast("timestamp")) - F.unix_micros(F.col("dropoff_time").cast("timestamp"))) / 1e6
    w = w.select("boroughcode", F.hour("pickup_time").alias("hour"), seconds.alias("wait")).where("wait >= 0")
    return T.running_stats(w, keys, F.col("wait"))


def trip_wait_stats_region_hour(spark: SparkSession, sf: str) -> DataFrame:
    return _wait_stats(spark, sf, ["boroughcode", "hour"])


def trip_wait_stats_region(spark: SparkSession, sf: str) -> DataFrame:
    return _wait_stats(spark, sf, ["boroughcode"])


QUERIES = {
    f.__name__: f
    for f in (
        trips_parse_good_bad, trip_hours_hist, trip_stats_diff_eq, trips_per_borough, trips_per_feature, trip_sum_avg_by_region, trip_sum_avg_by_dow, trip_group_cardinality, trip_busiest,
        haversine_norm_by_hour, trip_wait_hist, trip_wait_stats_region_hour, trip_wait_stats_region,
    )
}

_PARSE = r"try_strptime(CASE WHEN regexp_full_match({0}, '\d{{4}}-\d\d-\d\d \d\d:\d\d:\d\d') THEN {0} END, '%Y-%m-%d %H:%M:%S') IS NOT NULL"
_GOOD = " AND ".join([*[_PARSE.format(f"f[{k}]") for k in (6, 7)], *[f"try_cast(f[{k}] AS DOUBLE) IS NOT NULL" for k in (11, 12, 13, 14)], "f[2] IS NOT NULL"])
_BASE = (
    "WITH u AS (SELECT DISTINCT * EXCLUDE (received_at) FROM trips), h AS (SELECT *, (epoch_us(dropoff_time) - epoch_us(pickup_time)) AS us FROM u), "
    "g AS (SELECT *, CAST(trunc(us / 3600000000) AS BIGINT) AS hours FROM h), c0 AS (SELECT * FROM g WHERE hours >= 0 AND hours < 3), "
    "c AS (SELECT * FROM c0 WHERE (pickup_lon IS NULL OR NOT (pickup_lon = 0 AND pickup_lat = 0)) AND pickup_lon IS NOT NULL AND dropoff_lon IS NOT NULL AND NOT (dropoff_lon = 0 AND dropoff_lat = 0)) "
)
_BOROUGH = (
    ", rings AS (SELECT feature_id, boroughcode, unnest(from_json(json_extract(geojson, '$.coordinates'), '[[[\"DOUBLE\"]]]')) AS ring FROM boroughs), "
    "e AS (SELECT feature_id, boroughcode, unnest(list_zip(ring, list_concat(ring[2:], ring[1:1]))) AS s FROM rings), "
    "edges AS (SELECT feature_id, boroughcode, s[1][1] AS x1, s[1][2] AS y1, s[2][1] AS x2, s[2][2] AS y2 FROM e), "
    "ins AS (SELECT trip_id, feature_id, boroughcode FROM u JOIN edges ON (y1 > dropoff_lat) <> (y2 > dropoff_lat) AND dropoff_lon < (x2 - x1) * (dropoff_lat - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1), "
    "b AS (SELECT trip_id, CAST(min(boroughcode) AS BIGINT) AS boroughcode FROM ins GROUP BY trip_id) "
)
_WAIT = (
    _BASE + f", n AS (SELECT *, lead(pickup_time) OVER (PARTITION BY license ORDER BY pickup_time, trip_id) AS nx FROM c WHERE license IS NOT NULL AND pickup_time IS NOT NULL), "
    f"w AS (SELECT *, epoch_us(nx) - epoch_us(dropoff_time) AS wait_us FROM n WHERE nx - pickup_time < INTERVAL {GAP_H} HOUR) "
)
_STATS = "count(wait) AS n, avg(wait) AS mean, stddev_pop(wait) AS stdev, max(wait) AS largest, min(wait) AS smallest"
_WAIT_B = _WAIT + _BOROUGH + ", x AS (SELECT boroughcode, hour(pickup_time) AS hour, wait_us / 1e6 AS wait FROM w LEFT JOIN b USING (trip_id) WHERE wait_us >= 0) "
_DOW = _BASE + ", d AS (SELECT isodow(pickup_time) AS dow, CAST(sum(hours) AS BIGINT) AS sum_hours, avg(hours) AS mean_hours FROM c GROUP BY 1) "
_PER_B = _BASE + _BOROUGH + ", p AS (SELECT boroughcode, count(*) AS n FROM c0 LEFT JOIN b USING (trip_id) GROUP BY 1) "
_KM = "CAST(trunc(6371.0 * 2 * atan2(sqrt(a), sqrt(1 - a))) AS INTEGER)"

SQL = {
    "trips_parse_good_bad": f"WITH t AS (SELECT coalesce(string_split(raw_line, ','), []) AS f FROM raw_trips) SELECT coalesce({_GOOD}, false) AS ok, count(*) AS cnt FROM t GROUP BY 1",
    "trip_hours_hist": _BASE + "SELECT hours, count(*) AS cnt FROM g WHERE hours IS NOT NULL GROUP BY 1",
    "trip_stats_diff_eq": _BASE + f"SELECT {_HALF} AS same_location, count(*) AS n, CAST(sum(hours) AS BIGINT) AS sum_hours, avg(hours) AS mean_hours FROM c GROUP BY 1",
    "trips_per_borough": _PER_B + "SELECT * FROM p",
    "trips_per_feature": _BASE
    + _BOROUGH
    + ", ar AS (SELECT feature_id, boroughcode, sum(part) AS area FROM (SELECT feature_id, boroughcode, (CASE WHEN ring_no = 1 THEN 1 ELSE -1 END) * abs(list_sum([s[1][1] * s[2][2] - s[2][1] * s[1][2] FOR s IN list_zip(ring, list_concat(ring[2:], ring[1:1]))])) / 2 AS part "
    "FROM (SELECT feature_id, boroughcode, unnest(r) AS ring, unnest(range(1, len(r) + 1)) AS ring_no FROM (SELECT feature_id, boroughcode, from_json(json_extract(geojson, '$.coordinates'), '[[[\"DOUBLE\"]]]') AS r FROM boroughs))) GROUP BY ALL), "
    "bf AS (SELECT trip_id, first(feature_id ORDER BY boroughcode, area DESC, feature_id) AS feature_id FROM ins JOIN ar USING (feature_id, boroughcode) JOIN c0 USING (trip_id) GROUP BY trip_id) SELECT feature_id, count(*) AS n FROM bf GROUP BY 1",
    "trip_sum_avg_by_region": _BASE + _BOROUGH + "SELECT boroughcode, CAST(sum(hours) AS BIGINT) AS sum_hours, avg(hours) AS mean_hours, count(*) AS n FROM c LEFT JOIN b USING (trip_id) GROUP BY 1",
    "trip_sum_avg_by_dow": _DOW + "SELECT * FROM d",
    "trip_group_cardinality": _PER_B + "SELECT count(*) AS n_groups FROM p",
    "trip_busiest": _DOW + "SELECT dow, sum_hours FROM d ORDER BY sum_hours DESC, dow DESC LIMIT 1",
    "haversine_norm_by_hour": _BASE
    + ", v AS (SELECT hour(pickup_time) AS hour, CAST(trunc(us / 60000000) AS BIGINT) AS mins, pow(sin(radians(dropoff_lat - pickup_lat) / 2), 2) + cos(radians(pickup_lat)) * cos(radians(dropoff_lat)) * pow(sin(radians(dropoff_lon - pickup_lon) / 2), 2) AS a FROM c), "
    + f"k AS (SELECT hour, mins, {_KM} AS km FROM v) SELECT hour, avg(CASE WHEN km = 0 THEN mins ELSE mins / km END) AS mins_per_km, count(*) AS n FROM k GROUP BY hour",
    "trip_wait_hist": _WAIT + "SELECT CAST(trunc(wait_us / 3600000000) AS BIGINT) AS hours, count(*) AS cnt FROM w GROUP BY 1",
    "trip_wait_stats_region_hour": _WAIT_B + f"SELECT boroughcode, hour, {_STATS} FROM x GROUP BY boroughcode, hour",
    "trip_wait_stats_region": _WAIT_B + f"SELECT boroughcode, {_STATS} FROM x GROUP BY boroughcode",
}
