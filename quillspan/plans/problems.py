"""Queries of the general data-preparation problems (p2, p3, p4, p6, p7) and their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.faults import Measure, hourly_fences, implausible
from ..operators.multivalue import split_values
from ..operators.rejects import MOVIES, TRIPS, read_with_rejects
from ..operators.sessions import gap_sessions
from ..operators.spatial import match_points, point_targets, region_triangles
from ..runtime import cut, micros, table

#: Walking distance to a stand in metres, and the gap in hours that ends a working session.
WALK_M, GAP_H = 120.0, 4


def trip_ends(spark: SparkSession, sf: str) -> DataFrame:
    """trip_id, loc_end, lon, lat: each trip's known locations once."""
    t = table(spark, sf, "trips").select("trip_id", "pickup_lon", "pickup_lat", "dropoff_lon", "dropoff_lat").distinct()
    end = lambda e: F.when(F.col(f"{e}_lon").isNotNull() & F.col(f"{e}_lat").isNotNull(), F.struct(F.lit(e).alias("loc_end"), F.col(f"{e}_lon").alias("lon"), F.col(f"{e}_lat").alias("lat")))
    return t.select("trip_id", F.explode(F.array_compact(F.array(end("pickup"), end("dropoff")))).alias("e")).select("trip_id", "e.*")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    targets = region_triangles(table(spark, sf, "boroughs"), "boroughcode", "geojson").unionByName(point_targets(table(spark, sf, "stands"), "stand_id", "lon", "lat", WALK_M))
    hits = match_points(trip_ends(spark, sf), ["trip_id", "loc_end"], "lon", "lat", targets)
    return hits.select("trip_id", "loc_end", F.when(F.col("kind") == "region", "borough").otherwise("stand").alias("target_kind"), "target_id")


def p3_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = gap_sessions(table(spark, sf, "trips"), "license", "pickup_time", "trip_id", GAP_H * 3600, "dropoff_time")
    return s.select("license", "session", F.col("first_id").alias("first_trip_id"), F.col("last_id").alias("last_trip_id"), "start", "end", "duration_s", F.col("n_events").alias("n_trips"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_sessions(spark, sf).select("license", "first_trip_id", "last_trip_id")


def p4_trips(spark: SparkSession, sf: str) -> DataFrame:
    """All lines of raw_trips, typed or with the reason."""
    return read_with_rejects(table(spark, sf, "raw_trips"), "line_id", "raw_line", TRIPS)


def p4_movies(spark: SparkSession, sf: str) -> DataFrame:
    """All records of raw_movies, typed or with the reason."""
    return read_with_rejects(table(spark, sf, "raw_movies"), "line_id", "raw_line", MOVIES)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    bad = lambda df, name: df.where("reason is not null").select(F.lit(name).alias("raw_table"), "line_id", "reason")
    return bad(p4_trips(spark, sf), "raw_trips").unionByName(bad(p4_movies(spark, sf), "raw_movies")).distinct()


def trip_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Each trip once: license, trip_id, pickup_us, hour, duration_us, lon, lat."""
    t = table(spark, sf, "trips").select("license", "trip_id", "pickup_time", "dropoff_time", "pickup_lon", "pickup_lat").where("license is not null").distinct()
    return t.select(
        "license", "trip_id", micros("pickup_time").alias("pickup_us"), F.hour("pickup_time").alias("hour"),
        (micros("dropoff_time") - micros("pickup_time")).alias("duration_us"), F.col("pickup_lon").alias("lon"), F.col("pickup_lat").alias("lat"),
    )


TRIP_MEASURES = [
    Measure("duration", ("duration_us",), "duration_us < 0", lambda u: (u[0][0] > 5 * u[0][1]) | (10 * u[0][0] < u[0][1])),
    Measure("pickup_loc", ("lon", "lat"), "abs(lon) > 180 or abs(lat) > 90", lambda u: F.coalesce(F.abs(u[0][0] - u[0][1]) > 1, F.lit(False)) | F.coalesce(F.abs(u[1][0] - u[1][1]) > 1, F.lit(False))),
]


#: field_name -> column of the readings judged by the hour.
HOURLY_VALUES = {"duration": "duration_us", "pickup_lon": "lon", "pickup_lat": "lat"}


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return implausible(trip_readings(spark, sf), "license", "pickup_us", "trip_id", TRIP_MEASURES).select("trip_id", "field_name", "kind")


#: The same readings judged by the hour's fences and by their rates of change.
HOURLY_MEASURES = [Measure("duration", ("duration_us",), "duration_us < 0", fence=True), Measure("pickup_loc", ("lon", "lat"), "abs(lon) > 180 or abs(lat) > 90", fence=True, rate=True)]


def p6_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Impossible, outside the hour's fences, jumping, constant or stuck readings of each license."""
    return implausible(trip_readings(spark, sf), "license", "pickup_us", "trip_id", HOURLY_MEASURES, hour="hour").select("trip_id", "field_name", "kind")


def p6_hourly_fences(spark: SparkSession, sf: str) -> DataFrame:
    """Trips whose duration, pickup longitude or pickup latitude (field_name) is outside their license's fences for the hour, by sketches alone."""
    t = cut(trip_readings(spark, sf))
    each = [hourly_fences(t, "license", "hour", "trip_id", value).select("trip_id", F.lit(name).alias("field_name"), "low", "high", "kind") for name, value in HOURLY_VALUES.items()]
    return functools.reduce(DataFrame.unionByName, each)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return split_values(table(spark, sf, "movies"), "movie_id", ["director", "cast_names", "genre"], at_least=2)


def p7_values(spark: SparkSession, sf: str) -> DataFrame:
    """Also the fields that hold one value."""
    return split_values(table(spark, sf, "movies"), "movie_id", ["director", "cast_names", "genre"])


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_sessions, p4_found, p4_trips, p4_movies, p6_found, p6_faults, p6_hourly_fences, p7_found, p7_values)}

_SESSION_SQL = f"""
WITH t AS (SELECT DISTINCT license, pickup_time, dropoff_time, trip_id FROM trips WHERE license IS NOT NULL AND pickup_time IS NOT NULL),
m AS (SELECT *, CASE WHEN pickup_time - lag(pickup_time) OVER w >= INTERVAL {GAP_H} HOUR OR lag(pickup_time) OVER w IS NULL THEN 1 ELSE 0 END AS s
      FROM t WINDOW w AS (PARTITION BY license ORDER BY pickup_time, trip_id)),
g AS (SELECT *, sum(s) OVER (PARTITION BY license ORDER BY pickup_time, trip_id ROWS UNBOUNDED PRECEDING) AS session FROM m),
r AS (SELECT license, CAST(session AS BIGINT) AS session, first(trip_id ORDER BY pickup_time, trip_id) AS first_trip_id, last(trip_id ORDER BY pickup_time, trip_id) AS last_trip_id,
      min(pickup_time) AS start, last(coalesce(dropoff_time, pickup_time) ORDER BY pickup_time, trip_id) AS "end", count(*) AS n_trips FROM g GROUP BY license, session)
"""

_FAULTS_SQL = """
WITH t AS (SELECT DISTINCT trip_id, license, pickup_time, epoch_us(dropoff_time) - epoch_us(pickup_time) AS dur, pickup_lon AS lon, pickup_lat AS lat FROM trips WHERE license IS NOT NULL),
u AS (SELECT license, median(dur) AS md, count(dur) AS nd, median(lon) AS mx, median(lat) AS my, count(lon) AS nl FROM t GROUP BY license),
j AS (SELECT t.*, CASE WHEN nd >= 20 THEN md END AS md, CASE WHEN nl >= 20 THEN mx END AS mx, CASE WHEN nl >= 20 THEN my END AS my FROM t JOIN u USING (license)),
k AS (SELECT *, CASE WHEN dur IS NULL THEN NULL WHEN dur < 0 THEN 'impossible' WHEN dur > 5 * md OR 10 * dur < md THEN 'spike' ELSE '' END AS kd,
      CASE WHEN lon IS NULL OR lat IS NULL THEN NULL WHEN abs(lon) > 180 OR abs(lat) > 90 THEN 'impossible' WHEN abs(lon - mx) > 1 OR abs(lat - my) > 1 THEN 'spike' ELSE '' END AS kl FROM j),
rd AS (SELECT trip_id, license, pickup_time, dur AS a, 0::DOUBLE AS b FROM k WHERE kd = '' AND pickup_time IS NOT NULL),
rl AS (SELECT trip_id, license, pickup_time, lon AS a, lat AS b FROM k WHERE kl = '' AND pickup_time IS NOT NULL),
r AS (SELECT 'duration' AS field_name, * FROM rd UNION ALL SELECT 'pickup_loc', * FROM rl),
c AS (SELECT *, CASE WHEN a = lag(a) OVER w AND b = lag(b) OVER w THEN 0 ELSE 1 END AS n FROM r WINDOW w AS (PARTITION BY field_name, license ORDER BY pickup_time, trip_id)),
i AS (SELECT *, sum(n) OVER (PARTITION BY field_name, license ORDER BY pickup_time, trip_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
l AS (SELECT *, count(*) OVER (PARTITION BY field_name, license, run) AS len FROM i)
SELECT trip_id, 'duration' AS field_name, kd AS kind FROM k WHERE kd <> '' UNION ALL SELECT trip_id, 'pickup_loc', kl FROM k WHERE kl <> '' UNION ALL SELECT trip_id, field_name, 'stuck' FROM l WHERE len >= 5
"""

_NEAR_SQL = f"""
WITH t AS (SELECT DISTINCT trip_id, pickup_lon, pickup_lat, dropoff_lon, dropoff_lat FROM trips),
p AS (SELECT trip_id, 'pickup' AS loc_end, pickup_lon AS x, pickup_lat AS y FROM t UNION ALL SELECT trip_id, 'dropoff', dropoff_lon, dropoff_lat FROM t),
q AS (SELECT * FROM p WHERE x IS NOT NULL AND y IS NOT NULL),
rings AS (SELECT feature_id, boroughcode, unnest(from_json(json_extract(geojson, '$.coordinates'), '[[["DOUBLE"]]]')) AS ring FROM boroughs),
e AS (SELECT feature_id, boroughcode, unnest(list_zip(ring, list_concat(ring[2:], ring[1:1]))) AS s FROM rings),
edges AS (SELECT feature_id, boroughcode, s[1][1] AS x1, s[1][2] AS y1, s[2][1] AS x2, s[2][2] AS y2 FROM e),
inside AS (SELECT trip_id, loc_end, feature_id, boroughcode FROM q JOIN edges ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
           GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT trip_id, loc_end, 'borough' AS target_kind, CAST(min(boroughcode) AS BIGINT) AS target_id FROM inside GROUP BY trip_id, loc_end
UNION ALL
SELECT trip_id, loc_end, 'stand', stand_id FROM q JOIN stands ON 2 * 6371000.0 * asin(sqrt(least(1, pow(sin(radians(lat - y) / 2), 2) + cos(radians(y)) * cos(radians(lat)) * pow(sin(radians(lon - x) / 2), 2)))) <= {WALK_M}
"""

# separators that occur in these fields; brackets within brackets two deep
_VALUES_SQL = r"""
WITH m AS (SELECT DISTINCT movie_id, director, cast_names, genre FROM movies),
v AS (SELECT movie_id, field_name, trim(v, E' \t\n\r ') AS v FROM (UNPIVOT m ON director, cast_names, genre INTO NAME field_name VALUE v)),
k AS (SELECT movie_id, field_name, list_transform(regexp_extract_all(v, '"(?:[^"]|"")*"|\((?:[^()]|\([^()]*\))*\)|[,;:/|·•\n\r]|["()]|[^,;:/|·•\n\r"()]+'), lambda x: CASE
  WHEN regexp_full_match(x, '[,;:/|·•\n\r]') THEN chr(1) || x || chr(2)
  WHEN regexp_matches(x, '^["(].') THEN x
  ELSE regexp_replace(regexp_replace(x, '(\s)(and|&|\+|und|et|y)(\s)', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), '(\s)(and|&|\+|und|et|y)(\s)', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g') END) AS t FROM v),
j AS (SELECT movie_id, field_name, array_to_string(t, '') AS s FROM k),
g AS (SELECT movie_id, field_name, regexp_replace(regexp_replace(s, '([^\x01\x02\s]\s*)\x01([^\w&+])\x02(\s*(?:Jr\.?|Sr\.?|II|III|IV)\s*(?:$|\x01|\())', '\1\2\3', 'g'),
  '([^\x01\x02\s]\s*)\x01([^\w&+])\x02(\s*\((?:[^()]|\([^()]*\))*\))', '\1\2\3', 'g') AS s FROM j),
i AS (SELECT movie_id, field_name, list_filter(list_transform(regexp_split_to_array(s, '\x01[^\x02]*\x02'), lambda x: CASE
  WHEN regexp_full_match(trim(x, E' \t '), '"(?:[^"]|"")*"') THEN trim(replace(trim(x, E' \t ')[2:-2], '""', '"'), E' \t ') ELSE trim(x, E' \t ') END), lambda x: x <> '') AS a FROM g),
u AS (SELECT movie_id, field_name, len(a) AS n, unnest(a) AS item, CAST(unnest(range(1, len(a) + 1)) AS BIGINT) AS pos FROM i)
"""

_HOURLY_SQL = """
WITH t AS (SELECT DISTINCT trip_id, license, epoch_us(pickup_time) AS t, hour(pickup_time) AS hr, CAST(epoch_us(dropoff_time) - epoch_us(pickup_time) AS DOUBLE) AS duration,
           CASE WHEN pickup_lat IS NOT NULL THEN pickup_lon END AS lon, CASE WHEN pickup_lon IS NOT NULL THEN pickup_lat END AS lat FROM trips WHERE license IS NOT NULL),
o AS (SELECT *, (t - lag(t) OVER w) / 3.6e9 AS dt, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM t WHERE t IS NOT NULL WINDOW w AS (PARTITION BY license ORDER BY t, trip_id)),
r AS (SELECT trip_id, CASE WHEN dt > 0 THEN (lon - lon0) / dt END AS rate_lon, CASE WHEN dt > 0 THEN (lat - lat0) / dt END AS rate_lat FROM o),
x AS (SELECT t.*, rate_lon, rate_lat FROM t LEFT JOIN r USING (trip_id)),
l AS (SELECT trip_id, license, hr, name, v FROM x UNPIVOT (v FOR name IN (duration, lon, lat, rate_lon, rate_lat))),
h AS (SELECT license, hr, name, min(v) AS a, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3, max(v) AS b FROM l GROUP BY ALL HAVING count(*) >= 8),
s AS (SELECT license, name, min(v) AS a, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3, max(v) AS b FROM l GROUP BY ALL HAVING count(*) >= 8),
f AS (SELECT l.*, coalesce(h.a, s.a) AS a, coalesce(h.q1, s.q1) AS q1, coalesce(h.q3, s.q3) AS q3, coalesce(h.b, s.b) AS b FROM l LEFT JOIN h ON l.license = h.license AND l.name = h.name
      AND l.hr IS NOT DISTINCT FROM h.hr LEFT JOIN s ON l.license = s.license AND l.name = s.name),
g AS (SELECT trip_id, license, name, v, q1 - 3.0 * (q3 - q1) AS low, q3 + 3.0 * (q3 - q1) AS high, a = b AS flat FROM f)
"""
_KINDS_SQL = _HOURLY_SQL + """, m AS (SELECT trip_id, bool_or(name = 'duration' AND (v < low OR v > high)) AS dur_out, bool_or(name IN ('lon', 'lat') AND (v < low OR v > high)) AS loc_out,
bool_or(name LIKE 'rate%' AND (v < low OR v > high)) AS jump, bool_or(name = 'duration' AND flat) AS dur_flat, bool_or(name IN ('lon', 'lat') AND flat) AS loc_flat FROM g GROUP BY trip_id),
k AS (SELECT x.*, CASE WHEN duration IS NULL THEN NULL WHEN duration < 0 THEN 'impossible' WHEN dur_out THEN 'outside' WHEN dur_flat THEN 'constant' ELSE '' END AS kd,
      CASE WHEN lon IS NULL THEN NULL WHEN abs(lon) > 180 OR abs(lat) > 90 THEN 'impossible' WHEN loc_out THEN 'outside' WHEN jump THEN 'jump' WHEN loc_flat THEN 'constant' ELSE '' END AS kl
      FROM x LEFT JOIN m USING (trip_id)),
e AS (SELECT trip_id, license, t, 'duration' AS field_name, duration AS a, 0::DOUBLE AS b FROM k WHERE kd = '' AND t IS NOT NULL UNION ALL SELECT trip_id, license, t, 'pickup_loc', lon, lat FROM k WHERE kl = '' AND t IS NOT NULL),
c AS (SELECT *, CASE WHEN a = lag(a) OVER w AND b = lag(b) OVER w THEN 0 ELSE 1 END AS n FROM e WINDOW w AS (PARTITION BY field_name, license ORDER BY t, trip_id)),
i AS (SELECT *, sum(n) OVER (PARTITION BY field_name, license ORDER BY t, trip_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
q AS (SELECT *, count(*) OVER (PARTITION BY field_name, license, run) AS len FROM i)
SELECT trip_id, 'duration' AS field_name, kd AS kind FROM k WHERE kd <> '' UNION ALL SELECT trip_id, 'pickup_loc', kl FROM k WHERE kl <> '' UNION ALL SELECT trip_id, field_name, 'stuck' FROM q WHERE len >= 5
"""

_FIELD = r'(?:"(?:[^"]|"")*"|[^",][^,]*|)'
_TIME = r"(regexp_full_match({0}, '\d{{4}}-\d\d-\d\d \d\d:\d\d:[0-5]\d') AND try_strptime({0}, '%Y-%m-%d %H:%M:%S') IS NOT NULL)"
_NUM = r"(regexp_full_match({0}, '[+-]?(\d+(\.\d*)?|\.\d+)') AND abs(try_cast({0} AS DOUBLE)) <= {1})"
_RAW_SQL = (
    r"WITH t AS (SELECT line_id, raw_line, coalesce(string_split(raw_line, ','), []) AS f FROM raw_trips), "
    r"m AS (SELECT line_id, raw_line, coalesce(regexp_full_match(raw_line, '(?s)" + _FIELD + "(?:," + _FIELD + r")*'), true) AS sound, "
    r"regexp_extract_all(',' || raw_line, '(?s),(" + _FIELD + r")', 1) AS g FROM raw_movies), "
    r"n AS (SELECT line_id, raw_line, sound, coalesce(len(g), 0) AS c, [CASE WHEN x[1:1] = chr(34) THEN replace(x[2:-2], chr(34) || chr(34), chr(34)) ELSE x END FOR x IN g] AS f FROM m), "
    "rt AS (SELECT *, CASE WHEN len(f) <> 14 THEN 'columns' WHEN NOT (trim(f[2]) <> '' AND "
    + " AND ".join([*[_TIME.format(f"f[{k}]") for k in (6, 7)], *[_NUM.format(f"f[{k}]", v) for k, v in ((11, 180), (12, 90), (13, 180), (14, 90))]])
    + ") THEN 'value' END AS reason FROM t), rm AS (SELECT *, CASE WHEN NOT sound THEN 'quoting' WHEN c <> 8 THEN 'columns' "
    r"WHEN NOT (regexp_full_match(f[1], '[0-9]{4}') AND regexp_matches(f[2], '\S') AND regexp_matches(f[8], '\S')) THEN 'value' END AS reason FROM n) "
)


def _typed_sql(rows: str, columns: dict[str, str]) -> str:
    """Reason and raw line of the rejected records, typed columns of the others."""
    typed = ", ".join(f"CASE WHEN reason IS NULL THEN {e} END AS {n}" for n, e in columns.items())
    return _RAW_SQL + f"SELECT line_id, reason, CASE WHEN reason IS NOT NULL THEN raw_line END AS raw_line, {typed} FROM {rows}"


_TRIP_COLUMNS = {"license": "f[2]", **{n: f"try_strptime(f[{k}], '%Y-%m-%d %H:%M:%S')" for n, k in (("pickup_time", 6), ("dropoff_time", 7))}} | {
    n: f"try_cast(f[{k}] AS DOUBLE)" for n, k in (("pickup_lon", 11), ("pickup_lat", 12), ("dropoff_lon", 13), ("dropoff_lat", 14))
}
_MOVIE_COLUMNS = {"release_year": "try_cast(f[1] AS INTEGER)", **{n: f"f[{k + 2}]" for k, n in enumerate(("title", "origin", "director", "cast_names", "genre", "wiki_page", "plot"))}}

SQL = {
    "p2_found": _NEAR_SQL,
    "p3_found": _SESSION_SQL + "SELECT license, first_trip_id, last_trip_id FROM r",
    "p3_sessions": _SESSION_SQL + 'SELECT license, session, first_trip_id, last_trip_id, start, "end", (epoch_us("end") - epoch_us(start)) / 1e6 AS duration_s, n_trips FROM r',
    "p4_found": _RAW_SQL + "SELECT 'raw_trips' AS raw_table, line_id, reason FROM rt WHERE reason IS NOT NULL UNION ALL SELECT 'raw_movies', line_id, reason FROM rm WHERE reason IS NOT NULL",
    "p4_trips": _typed_sql("rt", _TRIP_COLUMNS),
    "p4_movies": _typed_sql("rm", _MOVIE_COLUMNS),
    "p6_found": _FAULTS_SQL,
    # quartiles are exact up to SKETCH_K readings of a license and hour, which the correctness tables don't exceed
    "p6_faults": _KINDS_SQL,
    "p6_hourly_fences": _HOURLY_SQL + "SELECT trip_id, CASE WHEN name = 'duration' THEN name ELSE 'pickup_' || name END AS field_name, low, high, CASE WHEN flat THEN 'constant' ELSE 'outside' END AS kind "
    "FROM g WHERE name NOT LIKE 'rate%' AND (flat OR v < low OR v > high)",
    "p7_values": _VALUES_SQL + "SELECT movie_id, field_name, pos, item FROM u",
    "p7_found": _VALUES_SQL + "SELECT movie_id, field_name, pos, item FROM u WHERE n >= 2",
}
