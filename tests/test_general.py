"""Operators of the general problems: brute force on small cases, nulls, empty tables, ties, repeats, clashing names."""

import csv
import datetime as dt
import math
import random
import statistics
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from quillspan.operators.faults import Measure, context_fences, exact_medians, hourly_fences, implausible, stuck_runs, with_rates
from quillspan.operators.geometry import Bvh, ear_clip, geojson_triangles
from quillspan.operators.multivalue import SPLITTING, items_of, split_values, tokens
from quillspan.operators.rejects import FILE_BYTES, MOVIES, TRIPS, _bounded, read_with_rejects
from quillspan.operators.sessions import gap_sessions
from quillspan.operators.spatial import EARTH_M, match_points, point_targets, region_faults, region_triangles

T0 = dt.datetime(2024, 1, 1)


# ------------------------------------------------------------------ sessions


def brute_sessions(rows, gap):
    by = defaultdict(list)
    for k, t, i in set(rows):
        if k is not None and t is not None:
            by[k].append((t, i))
    out = []
    for k, ev in by.items():
        ev.sort()
        cur = [ev[0]]
        for e in ev[1:]:
            if (e[0] - cur[-1][0]).total_seconds() >= gap:
                out.append((k, cur[0][1], cur[-1][1], len(cur)))
                cur = []
            cur.append(e)
        out.append((k, cur[0][1], cur[-1][1], len(cur)))
    return sorted(out)


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_sessions_against_brute_force(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), T0 + dt.timedelta(seconds=rng.choice([0, 3600, 7200, 14400, 14399, 1]) * rng.randrange(40)), n) for n in range(400)]
    rows += rows[:20] + [("a", None, 9999), ("early", dt.datetime(1960, 5, 1, 3), 1), ("early", dt.datetime(1960, 5, 1, 5), 2)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "k string, t timestamp_ntz, i bigint, session string, b int")
    got = gap_sessions(df, "k", "t", "i", 14400, block=block)
    assert sorted((r.k, r.first_id, r.last_id, r.n_events) for r in got.collect()) == brute_sessions(rows, 14400)


def test_session_gap_is_inclusive_and_empty_input_gives_none(spark):
    times = ["00:00:00", "03:59:59", "07:59:59", "12:00:00"]
    rows = [("l", dt.datetime.fromisoformat(f"2024-01-01 {t}"), n) for n, t in enumerate(times)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, i bigint")
    assert sorted((r.first_id, r.last_id) for r in gap_sessions(df, "k", "t", "i", 4 * 3600).collect()) == [(0, 1), (2, 2), (3, 3)]
    assert gap_sessions(df.where("false"), "k", "t", "i", 60).count() == 0


# ------------------------------------------------------------------ geometry


def inside_exact(rings, p):
    hit = False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1]):
            x1, y1, x2, y2, px, py = map(Fraction, (x1, y1, x2, y2, *p))
            if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                hit = not hit
    return hit


def star(rng, n, cx=0.0, cy=0.0, lo=0.4, hi=1.0):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + (r := rng.uniform(lo, hi)) * math.cos(a), cy + r * math.sin(a)) for a in angles]


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


@pytest.mark.parametrize("seed", range(6))
def test_ear_clipping_tiles_concave_polygons_with_holes(seed):
    rng = random.Random(seed)
    outer = star(rng, 25)
    holes = [star(rng, 6, 0.12, 0.05, 0.03, 0.08), star(rng, 5, -0.15, -0.1, 0.02, 0.07)]
    rings = [outer if seed % 2 else outer[::-1], *(h if seed % 3 else h[::-1] for h in holes)]
    tris = ear_clip([r + r[:1] for r in rings])
    assert math.isclose(sum(area([t[0:2], t[2:4], t[4:6]]) for t in tris), area(outer) - sum(map(area, holes)), rel_tol=1e-9)


def test_region_and_distance_matches_against_brute_force(spark):
    rng = random.Random(5)
    regions = [(code, [star(rng, 14, cx, cy, 0.5, 1.0), star(rng, 5, cx, cy, 0.1, 0.3)]) for code, cx, cy in ((3, 0, 0), (1, 0.8, 0.2), (2, 0.1, 0.9), (1, -1.5, 0))]
    import json

    reg = spark.createDataFrame([(c, json.dumps({"type": "Polygon", "coordinates": [[list(p) for p in r + r[:1]] for r in rings]})) for c, rings in regions] + [(9, None), (8, "no json"), (None, "{}")], "code int, g string")
    stands = [(i, rng.uniform(-0.01, 0.01), rng.uniform(-0.01, 0.01)) for i in range(30)] + [(77, 179.9999, 0.0), (78, 10.0, 89.9999)]
    st = spark.createDataFrame([*stands, (99, None, 1.0)], "id bigint, lon double, lat double")
    pts = [(i, rng.uniform(-2, 2), rng.uniform(-1, 2)) for i in range(300)] + [(1000 + i, rng.uniform(-0.01, 0.01), rng.uniform(-0.01, 0.01)) for i in range(200)]
    pts += [(5000, -179.9999, 0.0), (5001, -170.0, 89.9999), (5002, None, 0.0), (5003, float("nan"), 0.0)]
    points = spark.createDataFrame(pts, "p bigint, lon double, lat double")
    targets = region_triangles(reg, "code", "g").unionByName(point_targets(st, "id", "lon", "lat", 300.0))
    want = set()
    for p, x, y in pts:
        if x is None or math.isnan(x):
            continue
        codes = [c for c, rings in regions if inside_exact(rings, (x, y))]
        if codes:
            want.add((p, "region", min(codes)))
        for i, sx, sy in stands:
            a = math.sin(math.radians(sy - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(sy)) * math.sin(math.radians(sx - x) / 2) ** 2
            if 2 * EARTH_M * math.asin(math.sqrt(a)) <= 300:
                want.add((p, "point", i))
    assert {(5000, "point", 77), (5001, "point", 78)} <= want
    for how in ({}, {"max_broadcast": 3, "block_targets": 15, "group_points": 40}):
        assert Counter(tuple(r) for r in match_points(points, ["p"], "lon", "lat", targets, **how).collect()) == Counter(want)
    assert match_points(points.where("false"), ["p"], "lon", "lat", targets).count() == 0
    assert match_points(points, ["p"], "lon", "lat", targets.where("false")).count() == 0


def test_lower_code_wins_where_regions_overlap_and_borders_belong(spark):
    sq = lambda a, b: f'{{"type":"Polygon","coordinates":[[[{a},{a}],[{b},{a}],[{b},{b}],[{a},{b}],[{a},{a}]]]}}'
    t = region_triangles(spark.createDataFrame([(1, sq(0, 10)), (2, sq(5, 15))], "c int, g string"), "c", "g")
    p = spark.createDataFrame([(1, 2.0, 2.0), (2, 7.0, 7.0), (3, 12.0, 12.0), (4, 20.0, 20.0), (5, 5.0, 5.0), (6, 0.0, 3.0)], "i int, x double, y double")
    assert {(r.i, r.target_id) for r in match_points(p, ["i"], "x", "y", t).collect()} == {(1, 1), (2, 1), (3, 2), (5, 1), (6, 1)}
    assert {(r.i, r.target_id) for r in match_points(p, ["i"], "x", "y", t, first_region=False).collect()} == {(1, 1), (2, 1), (2, 2), (3, 2), (5, 1), (5, 2), (6, 1)}


def test_repeated_points_and_misses_come_alike_on_both_ways(spark):
    sq = lambda a, b: f'{{"type":"Polygon","coordinates":[[[{a},{a}],[{b},{a}],[{b},{b}],[{a},{b}],[{a},{a}]]]}}'
    t = region_triangles(spark.createDataFrame([(1, sq(0, 10)), (2, sq(5, 15))], "c int, g string"), "c", "g")
    stands = spark.createDataFrame([(7, 7.0, 7.0), (8, 7.0, 7.0)], "id int, x double, y double")
    t = t.unionByName(point_targets(stands, "id", "x", "y", 50.0))
    rows = [("a", 7.0, 7.0)] * 3 + [("a", 1.0, 1.0), ("b", 40.0, 40.0), ("b", 40.0, 40.0), (None, None, 1.0), ("n", float("nan"), 1.0)]
    p = spark.createDataFrame(rows, "i string, x double, y double")
    for first in (True, False):
        region = [("region", 1)] if first else [("region", 1), ("region", 2)]
        want = Counter({("a", *k): 3 for k in [*region, ("point", 7), ("point", 8)]})
        want["a", "region", 1] += 1
        missed = Counter({("b", None, None): 2, (None, None, None): 1, ("n", None, None): 1})
        for how in ({}, {"max_broadcast": 1, "block_targets": 2, "group_points": 2}):
            assert Counter(tuple(r) for r in match_points(p, ["i"], "x", "y", t, first, **how).collect()) == want
            assert Counter(tuple(r) for r in match_points(p, ["i"], "x", "y", t, first, outer=True, **how).collect()) == want + missed


def test_broken_features_are_named_and_the_others_matched(spark):
    poly = lambda *rings: __import__("json").dumps({"type": "Polygon", "coordinates": [[list(p) for p in r] for r in rings]})
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    rows = [(1, poly(square)), (2, poly([(0, 0), (4, 4), (4, 0), (0, 4)])), (3, None), (4, "{"), (5, '{"type":"Polygon","coordinates":[[["x",1],[2,3],[4,5]]]}'), (6, '{"type":"Point","coordinates":[1,2]}')]
    rows += [(7, poly(square, [(9, 9), (10, 9), (10, 10)])), (8, '{"type":"Polygon"}'), (None, poly(square))]
    df = spark.createDataFrame(rows, "c int, g string")
    assert {r.c for r in region_faults(df, "c", "g").collect()} == {2, 3, 4, 5, 6, 7, 8}
    assert {r.c: r.fault for r in region_faults(df, "c", "g").collect()}[2] == "the ring crosses itself"
    assert {r.target_id for r in region_triangles(df, "c", "g").collect()} == {1}


def test_ear_clipping_of_many_corners_with_holes_takes_little_time():
    import time

    rng = random.Random(8)
    outer = star(rng, 20_000, lo=0.9)
    holes = [star(rng, 300, 0.5 * math.cos(a), 0.5 * math.sin(a), 0.05, 0.1) for a in (0, 1, 2, 3, 4, 5)]
    began = time.perf_counter()
    tris = ear_clip([outer, *holes])
    assert time.perf_counter() - began < 30
    assert len(tris) == 20_000 + 6 * 302 - 2
    assert math.isclose(sum(area([t[0:2], t[2:4], t[4:6]]) for t in tris), area(outer) - sum(map(area, holes)), rel_tol=1e-9)


def test_hierarchy_finds_every_box():
    rng = np.random.default_rng(1)
    lo = rng.uniform(0, 1, (200, 3))
    hi = lo + rng.uniform(0, 0.2, (200, 3))
    p = rng.uniform(0, 1.2, (300, 3))
    at, box = Bvh(lo, hi).candidates(p)
    want = {(i, j) for i in range(300) for j in range(200) if (p[i] >= lo[j]).all() and (p[i] <= hi[j]).all()}
    assert set(zip(at.tolist(), box.tolist())) == want
    assert geojson_triangles('{"type":"Point","coordinates":[1,2]}') == []


# ------------------------------------------------------------------ records that can't be read


def brute_movie(line):
    if line is None:
        return "columns"
    fields, i, n = [], 0, len(line)
    while True:
        if line[i : i + 1] == '"':
            j = i + 1
            while True:
                k = line.find('"', j)
                if k < 0:
                    return "quoting"
                if line[k + 1 : k + 2] == '"':
                    j = k + 2
                    continue
                break
            fields.append(line[i + 1 : k].replace('""', '"'))
            i = k + 1
            if i == n:
                break
            if line[i] != ",":
                return "quoting"
            i += 1
        else:
            k = line.find(",", i)
            fields.append(line[i:] if k < 0 else line[i:k])
            if k < 0:
                break
            i = k + 1
    if len(fields) != 8:
        return "columns"
    year = fields[0]
    if not (len(year) == 4 and year.isascii() and year.isdigit() and fields[1].strip() and fields[7].strip()):
        return "value"
    return fields


def test_movie_records_against_brute_force(spark):
    rng = random.Random(3)
    bits = ['"', '""', ",", "a", " ", "\n", "x y", "\r\n", '"q"', ",,", "1999"]
    lines = [None, "", "   ", '"', '1999,t,o,d,c,g,w,"open', '1999,t,o,d,c,g,w,"a" ,', "1999,t,o,d,c,g,w,p" + "x" * 100_000, '1999,"a\nb",o,d,c,g,w,"say ""hi"""', "1999,t,o,d,c,g,w,5\" disk", '1999,t,o,d,c,g,w,""']
    for _ in range(600):
        fields = ["1999", "t", "o", "d", "c", "g", "w", "p"]
        for _ in range(rng.randrange(4)):
            fields[rng.randrange(8)] = "".join(rng.choice(bits) for _ in range(rng.randrange(5)))
        lines.append(",".join(fields))
    df = spark.createDataFrame([(n, x, "clash") for n, x in enumerate(lines)], "id bigint, raw string, title string").repartition(3)
    sizes = [b.num_rows for b in _bounded(__import__("pyarrow").RecordBatch.from_arrays([[*range(5)], ["a" * (FILE_BYTES - 1), "bb", None, "c" * 2 * FILE_BYTES, "d"]], ["id", "raw"]))]
    assert sizes == [1, 2, 1, 1]
    got = {r.id: r for r in read_with_rejects(df, "id", "raw", MOVIES).collect()}
    assert len(got) == len(lines)
    for n, x in enumerate(lines):
        want = brute_movie(x)
        if isinstance(want, str):
            assert got[n].reason == want, (x, got[n])
        else:
            assert got[n].reason is None, (x, got[n])
            assert [got[n].title, got[n].plot] == [want[1], want[7]]


def test_trip_lines(spark):
    good = "A,L1,X,5,Y,2001-02-14 13:07:25,2001-02-14 14:14:00,5,3995,21.03,-31.16,44.79,-31.29,44.75"
    f = good.split(",")
    change = lambda k, v: ",".join([*f[:k], v, *f[k + 1 :]])
    cases = {
        good: None, "": "columns", None: "columns", good + ",": "columns", good[:40]: "columns", change(1, " "): "value", change(5, "2001-02-30 10:00:00"): "value", change(5, "2001-2-14 10:00:00"): "value",
        change(6, "2001-02-14 24:00:00"): "value", change(10, "1e2"): "value", change(10, "nan"): "value", change(10, "-180.5"): "value", change(11, "90"): None, change(12, '"-31.2"'): "value", change(13, " 44"): "value", change(2, '"'): None,
    }
    rows = list(cases.items())
    df = spark.createDataFrame([(n, x) for n, (x, _) in enumerate(rows)], "id bigint, raw string")
    got = {r.id: r for r in read_with_rejects(df, "id", "raw", TRIPS).collect()}
    assert [got[n].reason for n in range(len(rows))] == [w for _, w in rows]
    assert got[0].pickup_time == dt.datetime(2001, 2, 14, 13, 7, 25) and got[0].dropoff_lat == 44.75
    assert read_with_rejects(df.where("false"), "id", "raw", TRIPS).count() == 0
    assert list(csv.reader([good]))[0] == f


# ------------------------------------------------------------------ faults


def test_medians_are_exact_for_hot_and_small_sources(spark):
    rng = random.Random(9)
    rows = [("hot", float(rng.choice([1, 2, 3, rng.random() * 100]))) for _ in range(5000)] + [(f"s{i % 7}", float(rng.randrange(50))) for i in range(100)]
    rows += [("null", None), (None, 1.0)]
    got = {r.s: (r.n_x, r.med_x) for r in exact_medians(spark.createDataFrame(rows, "s string, x double").repartition(5), "s", {"x": __import__("pyspark.sql.functions", fromlist=["col"]).col("x")}).collect() if r.s}
    by = defaultdict(list)
    for s, x in rows:
        if s and x is not None:
            by[s].append(x)
    assert {s: (len(v), statistics.median(v)) for s, v in by.items()} == {s: v for s, v in got.items() if s != "null"}
    assert got["null"] == (0, None)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_stuck_runs_cross_partitions(spark, parts):
    rng = random.Random(parts)
    rows = []
    for s in ("hot", "b", "c"):
        for n in range(150 if s == "hot" else 20):
            rows.append((s, n // 2, n + (1000 if s == "b" else 0) + (2000 if s == "c" else 0), rng.choice([7, 7, 7, 7, 8, None]), 1 if s != "b" else n))
    got = {(r.i, r.mark) for r in stuck_runs(spark.createDataFrame(rows, "s string, t bigint, i bigint, m bigint, k bigint"), "s", "t", "i", ["m", "k"], 5, parts).collect()}
    want = set()
    for mark, col in (("m", 3), ("k", 4)):
        for s in ("hot", "b", "c"):
            run = []
            for r in [*sorted((r for r in rows if r[0] == s and r[col] is not None), key=lambda r: (r[1], r[2])), None]:
                if r is not None and run and run[-1][col] == r[col]:
                    run.append(r)
                    continue
                if len(run) >= 5:
                    want |= {(x[2], mark) for x in run}
                run = [r] if r else []
    assert got == want


def test_faults_on_empty_input_and_few_values(spark):
    m = [Measure("v", ("x",), "x < 0", lambda u: u[0][0] > 5 * u[0][1])]
    df = spark.createDataFrame([("a", 1, 1, 1.0), ("a", 2, 2, -1.0), ("a", 3, 3, 500.0), (None, 4, 4, -1.0), ("a", None, 5, None)], "s string, t bigint, i bigint, x double")
    assert {tuple(r) for r in implausible(df, "s", "t", "i", m).collect()} == {(2, "v", "impossible")}
    assert implausible(df.where("false"), "s", "t", "i", m).count() == 0
    assert implausible(df, "s", "t", "i", m, min_values=3).where("kind = 'spike'").count() == 1
    assert hourly_fences(df.withColumn("h", df.t), "s", "h", "i", "x").count() == 0


@pytest.mark.parametrize("parts", ["1", "7"])
def test_rates_of_change_against_brute_force(spark, parts):
    rng = random.Random(int(parts))
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.choice([None, *range(0, 10**12, 10**10)]), n, rng.choice([None, rng.random(), 5.0])) for n in range(300)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.i: r.rate_x for r in with_rates(spark.createDataFrame(rows, "s string, t bigint, i bigint, x double"), "s", "t", "i", ["x"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert len(got) == 300
    for source in ("hot", "b", None):
        mine = sorted((r for r in rows if r[0] == source and r[1] is not None), key=lambda r: (r[1], r[2]))
        for a, b in zip([None, *mine], mine):
            known = source is not None and a is not None and b[1] > a[1] and None not in (a[3], b[3])
            assert (got[b[2]] is not None) == known
            assert not known or math.isclose(got[b[2]], (b[3] - a[3]) / ((b[1] - a[1]) / 3.6e9))
    assert all(got[r[2]] is None for r in rows if r[1] is None)


def test_kinds_by_hour_and_rate_against_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for n in range(600):
        source = rng.choice(["hot", "hot", "a", "b", "flat", None])
        x = 4.0 if source == "flat" else rng.choice([None, rng.gauss(10, 1), rng.gauss(10, 1), rng.gauss(10, 1), 60.0 if rng.random() < 0.1 else 10.5])
        rows.append((source, rng.choice([None, n * 3_600_000_000]), n, rng.choice([None, 3, 3, 4]), x))
    df = spark.createDataFrame(rows, "s string, t bigint, i bigint, h int, x double").repartition(6)
    got = {(r.i, r.kind) for r in implausible(df, "s", "t", "i", [Measure("v", ("x",), "x > 55", fence=True, rate=True)], hour="h", stuck_at=10**6).collect()}

    def fences(values):
        if len(values) < 8:
            return None
        v = sorted(values)
        q1, q3 = (v[math.ceil(q * len(v)) - 1] for q in (0.25, 0.75))
        return q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1), v[0] == v[-1]

    rate, last = {}, {}
    for s, t, i, _, x in sorted((r for r in rows if r[0] and r[1] is not None), key=lambda r: (r[1], r[2])):
        if s in last and None not in (x, last[s][1]):
            rate[i] = (x - last[s][1]) / ((t - last[s][0]) / 3.6e9)
        last[s] = (t, x)
    of = lambda pick, s, h=...: [v for r in rows if r[0] == s and (h is ... or r[3] == h) and (v := pick(r)) is not None]
    want = set()
    for r in rows:
        s, _, i, h, x = r
        if s is None or x is None:
            continue
        value, change = (lambda q: q[4]), (lambda q: rate.get(q[2]))
        f, g = (fences(of(p, s, h)) or fences(of(p, s)) for p in (value, change))
        if x > 55:
            want.add((i, "impossible"))
        elif f and not f[0] <= x <= f[1]:
            want.add((i, "outside"))
        elif g and i in rate and not g[0] <= rate[i] <= g[1]:
            want.add((i, "jump"))
        elif f and f[2]:
            want.add((i, "constant"))
    assert got == want and {k for _, k in want} == {"impossible", "outside", "jump", "constant"}
    assert implausible(df.where("false"), "s", "t", "i", [Measure("v", ("x",), fence=True, rate=True)], hour="h").count() == 0


def test_hot_sources_are_joined_apart_beyond_the_broadcast_bound(spark):
    from quillspan.runtime import bytes_of, join_per_key

    rows = spark.createDataFrame([("hot", n) for n in range(50)] + [("a", 1), ("b", 2), (None, 3)], "k string, v int")
    per = spark.createDataFrame([("hot", 50, "h"), ("a", 1, "x"), ("c", 1, "y")], "k string, n int, w string")
    want = sorted([("hot", n, 50, "h") for n in range(50)] + [("a", 1, 1, "x")])
    for how in ({}, {"max_bytes": 0, "hot_rows": 10}, {"max_bytes": 0, "hot_rows": 1000}):
        assert sorted(tuple(r) for r in join_per_key(rows, per, "k", "n", **how).collect()) == want
    assert bytes_of(per.where("false")) == 0 < bytes_of(per)
    hot = context_fences(rows.withColumn("h", rows.v % 2), "k", "h", ["v"]).where("k = 'hot'").first()
    assert set(hot.hours) == {0, 1} and (hot.hours[0].low_v, hot.hours[0].high_v, hot.hours[0].flat_v) == (-60.0, 108.0, False) and hot.n_rows == 50


def test_hourly_fences(spark):
    rows = [("a", 5, n, 10.0 + n % 5) for n in range(50)] + [("a", 5, 100, 999.0)] + [("b", 1, 200 + n, 3.0) for n in range(9)] + [("c", 1, 300, 1.0)]
    got = {(r.i, r.kind) for r in hourly_fences(spark.createDataFrame(rows, "s string, h int, i bigint, x double"), "s", "h", "i", "x").collect()}
    assert got == {(100, "outside"), *((200 + n, "constant") for n in range(9))}


# ------------------------------------------------------------------ several values in one field

CASES = {
    "A B, C D and E F": ["A B", "C D", "E F"], "A B, C D, and E F ,": ["A B", "C D", "E F"], "K L, M N, Jr., and B C": ["K L", "M N, Jr.", "B C"],
    '"W, N" | X Y': ["W, N", "X Y"], '"D, T ""B""" / Z': ['D, T "B"', "Z"], 'B "R" T and P S (as Duke and Baron)': ['B "R" T', "P S (as Duke and Baron)"],
    "rock-and-roll musical & R&B musical;drama": ["rock-and-roll musical", "R&B musical", "drama"], "X, (uncredited), Y": ["X, (uncredited)", "Y"], "A\nB\r\nC": ["A", "B", "C"],
    ' " western " ; "" ; war ': ["western", "war"], "K, III/ B": ["K, III", "B"], 'a "b, c': ['a "b', "c"], "a (b, c": ["a (b", "c"], "and B": ["and B"], "A and": ["A and"],
    '"sword and sandal"': ["sword and sandal"], "d'Sepal · O.K. Jones": ["d'Sepal", "O.K. Jones"], 'A, "B" (voice), C': ["A", '"B" (voice)', "C"], ",;,": [], "   ": [], "": [], None: [],
    "x," * 2000: ["x"] * 2000, "word " * 50_000 + ", b": [("word " * 50_000).strip(), "b"],
}


def test_values_packed_in_one_field(spark):
    keys = list(CASES)
    rows = [(n, k, "clash") for n, k in enumerate(keys)] * 2 + [(None, "A, B", "x")]
    df = spark.createDataFrame(rows, "id int, v string, item string")
    got = defaultdict(dict)
    for r in split_values(df, "id", ["v"]).collect():
        assert r.pos not in got[r.id]
        got[r.id][r.pos] = r.item
    for n, k in enumerate(keys):
        assert [got[n][p] for p in sorted(got[n])] == CASES[k]
    assert sorted(got[None].values()) == ["A", "B"]
    assert split_values(df.where("false"), "id", ["v"]).count() == 0
    assert {r.id for r in split_values(df, "id", ["v"], at_least=2).collect()} == {n for n, k in enumerate(keys) if len(CASES[k]) > 1} | {None}


def test_skeletons_and_their_units():
    assert tokens("A B, C and D")[1] == "xpxwx" and tokens('"a, b" (c (d), e); II')[1] == "QRps" and tokens('"  ",(x')[1] == "Epxx"
    assert "".join(tokens("A , B (c)  / D ")[0]) == "A , B (c)  / D "
    assert {"xpx$", "^pxp", "xwR$", "ppR$", "xpsx"} <= SPLITTING and not {"xps$", "xpRx", "Qpsp"} & SPLITTING
    assert items_of("A, and, B") == ["A", "and", "B"] and items_of("A and and B") == ["A", "B"]
    assert items_of("x (a (b, c) d, e), y") == ["x (a (b, c) d, e)", "y"] and items_of("(" * 20_000 + ", a") == ["(" * 20_000, "a"]


def test_hourly_fences_of_the_location(spark, tmp_path):
    from quillspan.plans.problems import p6_hourly_fences

    at = lambda minute: dt.datetime(2024, 1, 1, 8, minute)
    rows = [(i, "a", at(i), at(i + 5 + i % 5), -74.0 + i / 1000, 40.0 + i % 7 / 1000) for i in range(40)]
    rows += [(100, "a", at(41), at(48), -70.0, 40.003), (101, "a", at(42), at(49), -73.98, 44.0)]
    rows += [(200 + i, "b", at(i), at(i + 5 + i % 5), -74.0, 40.0 + i % 7 / 1000) for i in range(10)]
    spark.createDataFrame(rows, "trip_id bigint, license string, pickup_time timestamp, dropoff_time timestamp, pickup_lon double, pickup_lat double").write.parquet(f"{tmp_path}/trips.parquet")
    got = {(r.trip_id, r.field_name, r.kind) for r in p6_hourly_fences(spark, str(tmp_path)).collect()}
    assert got == {(100, "pickup_lon", "outside"), (101, "pickup_lat", "outside")} | {(200 + i, "pickup_lon", "constant") for i in range(10)}
