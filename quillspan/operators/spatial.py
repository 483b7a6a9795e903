"""Points near other points or inside regions.

Regions are triangulated by ear clipping on the workers. Targets (triangles in the plane; discs around points as boxes in space, which
needs no care at the poles or the date line) are laid into a bounding-volume hierarchy. Up to ``max_broadcast`` targets the whole
tree goes to every task; beyond that the targets are cut into blocks along a space-filling order, only the blocks' boxes go to every
task, and points meet the blocks they fall into by a salted shuffle. Candidates are tested exactly either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut
from .geometry import Bvh, geojson_area, orient_many, triangulate

#: Radius in metres of the sphere on which distances are measured.
EARTH_M = 6_371_000.0
#: Most targets whose tree is sent to every task (about 100 bytes each).
MAX_BROADCAST = 200_000
#: Targets per block, and points per group, of the shuffled way.
BLOCK_TARGETS, GROUP_POINTS = 20_000, 200_000

_TARGET = "target_id bigint, kind string, g array<double>"


def region_triangles(regions: DataFrame, region_id: str, geojson: str) -> DataFrame:
    """Targets of the kind ``region``: one row per triangle. Null or broken geometries have none (``region_faults`` names them)."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tris = [], []
            for i, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i is not None:
                    t = triangulate(g)[0]
                    ids += [i] * len(t)
                    tris += [list(x) for x in t]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(["region"] * len(ids), pa.string()), pa.array(tris, pa.list_(pa.float64()))], ["target_id", "kind", "g"])

    return regions.select(F.col(region_id).cast("bigint"), F.col(geojson)).mapInArrow(cut_up, _TARGET)


def region_facts(regions: DataFrame, region_id: str, geojson: str) -> DataFrame:
    """region_id, area (plane), fault: one row per feature with an id; fault says why a feature has no triangles, and then area is null."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([geojson_area(x) for x in g], pa.float64()), pa.array([triangulate(x)[1] for x in g], pa.string())], [region_id, "area", "fault"])

    return regions.where(F.col(region_id).isNotNull()).select(F.col(region_id).cast("bigint").alias(region_id), F.col(geojson)).mapInArrow(look, f"`{region_id}` bigint, area double, fault string")


def region_faults(regions: DataFrame, region_id: str, geojson: str) -> DataFrame:
    """region_id, fault: the features without triangles, with the reason."""
    return region_facts(regions, region_id, geojson).where("fault is not null").select(region_id, "fault")


def point_targets(points: DataFrame, point_id: str, lon: str, lat: str, within_m: float) -> DataFrame:
    """Targets of the kind ``point``: a disc of ``within_m`` metres around each point. Points without a location have none."""
    return points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull() & F.col(point_id).isNotNull()).select(
        F.col(point_id).cast("bigint").alias("target_id"), F.lit("point").alias("kind"), F.array(F.col(lon).cast("double"), F.col(lat).cast("double"), F.lit(float(within_m))).alias("g")
    )


def _unit(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    lon, lat = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def haversine_m(lon1, lat1, lon2, lat2) -> np.ndarray:
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.clip(a, 0, 1)))


def _half_chord(within_m: np.ndarray) -> np.ndarray:
    """Half the side of a box around a disc's points on the unit sphere, with room for rounding."""
    return 2 * np.sin(np.clip(within_m / EARTH_M, 0, np.pi) / 2) * (1 + 1e-9) + 1e-12


class Targets:
    """Trees over triangles and discs, and the exact tests."""

    def __init__(self, ids: np.ndarray, regions: np.ndarray, discs: np.ndarray, disc_ids: np.ndarray):
        self.ids, self.tri, self.disc, self.disc_ids = ids, regions.reshape(-1, 6), discs.reshape(-1, 3), disc_ids
        x, y = self.tri[:, 0::2], self.tri[:, 1::2]
        self.tri_tree = Bvh(np.stack([x.min(axis=1), y.min(axis=1)], axis=1), np.stack([x.max(axis=1), y.max(axis=1)], axis=1))
        c, r = _unit(self.disc[:, 0], self.disc[:, 1]), _half_chord(self.disc[:, 2])[:, None]
        self.disc_tree = Bvh(c - r, c + r)

    def match(self, lon: np.ndarray, lat: np.ndarray, first_region: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point index, target id, is region) of all hits; a region hit through several triangles comes once."""
        ok = np.flatnonzero(np.isfinite(lon) & np.isfinite(lat))
        lon, lat = lon[ok], lat[ok]
        at, j = self.tri_tree.candidates(np.stack([lon, lat], axis=1))
        t, px, py = self.tri[j], lon[at], lat[at]
        inside = np.ones(len(at), bool)
        for a, b in ((0, 2), (2, 4), (4, 0)):
            live = np.flatnonzero(inside)
            inside[live] = orient_many(t[live, a], t[live, a + 1], t[live, b], t[live, b + 1], px[live], py[live]) >= 0
        at, rid = at[inside], self.ids[j[inside]]
        if len(at):
            by = np.lexsort((rid, at))
            at, rid = at[by], rid[by]
            new = np.r_[True, (at[1:] != at[:-1]) if first_region else ((at[1:] != at[:-1]) | (rid[1:] != rid[:-1]))]
            at, rid = at[new], rid[new]
        da, dj = self.disc_tree.candidates(_unit(lon, lat))
        d = self.disc[dj]
        near = haversine_m(lon[da], lat[da], d[:, 0], d[:, 1]) <= d[:, 2]
        da, did = da[near], self.disc_ids[dj[near]]
        return ok[np.concatenate([at, da])], np.concatenate([rid, did]), np.r_[np.ones(len(at), bool), np.zeros(len(da), bool)]


def _targets(ids: list, kinds: list, gs: list) -> Targets:
    reg, disc = [(i, g) for i, k, g in zip(ids, kinds, gs) if k == "region"], [(i, g) for i, k, g in zip(ids, kinds, gs) if k == "point"]
    arr = lambda x, w: np.array([g for _, g in x], dtype=float).reshape(-1, w)
    return Targets(np.array([i for i, _ in reg], dtype=np.int64), arr(reg, 6), arr(disc, 3), np.array([i for i, _ in disc], dtype=np.int64))


def _emit(batch: pa.RecordBatch, n_keep: int, hit: tuple, outer: bool = False) -> pa.RecordBatch:
    at, tid, region = hit
    miss = np.setdiff1d(np.arange(batch.num_rows), at) if outer else np.empty(0, np.int64)
    idx, none = pa.array(np.r_[at, miss].astype(np.int64)), np.r_[np.zeros(len(at), bool), np.ones(len(miss), bool)]
    fill = lambda v, kind: pa.array(np.r_[v, np.zeros(len(miss), v.dtype)], kind, mask=none)
    kinds = pa.DictionaryArray.from_arrays(fill(region.astype(np.int8), pa.int8()), pa.array(["point", "region"])).cast(pa.string())
    names = [*batch.schema.names[:n_keep], "kind", "target_id"]
    return pa.RecordBatch.from_arrays([*[batch.column(k).take(idx) for k in range(n_keep)], kinds, fill(np.asarray(tid, np.int64), pa.int64())], names)


def _coords(batch: pa.RecordBatch, n_keep: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(n_keep + k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1))


def match_points(
    points: DataFrame, keep: list[str], lon: str, lat: str, targets: DataFrame, first_region: bool = True, outer: bool = False, max_broadcast: int = MAX_BROADCAST, block_targets: int = BLOCK_TARGETS,
    group_points: int = GROUP_POINTS,
) -> DataFrame:
    """Columns ``keep`` of each point, kind (``point`` or ``region``) and target_id: one row per target that holds the point.

    With ``first_region`` a point in several regions gets the lowest region id, otherwise all of them; a border belongs to its region. A point without a
    location, or with one that isn't finite, hits nothing. Points that hit nothing give no row or, with ``outer``, one whose kind and target_id are null.
    Repeated points are each matched. Longitudes and latitudes may be any number: on the sphere they are angles, in the plane coordinates.
    """
    spark = points.sparkSession
    p = points.select(*keep, F.col(lon).cast("double").alias("_lon"), F.col(lat).cast("double").alias("_lat"))
    if not outer:
        p = p.where("_lon is not null and _lat is not null")
    n_keep = len(keep)
    schema = T.StructType([*p.schema.fields[:n_keep], T.StructField("kind", T.StringType()), T.StructField("target_id", T.LongType())])
    targets = cut(targets)
    if targets.limit(max_broadcast + 1).count() <= max_broadcast:
        rows = targets.collect()  # proven to be at most max_broadcast rows
        sent = spark.sparkContext.broadcast(_targets(*([r[k] for r in rows] for k in range(3))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = sent.value
            for b in batches:
                yield _emit(b, n_keep, t.match(*_coords(b, n_keep), first_region), outer)

        return p.mapInArrow(run, schema)
    # a point meets several blocks and a region may be spread over several: its hits are put together by the number of its row
    at = p.columns[:n_keep]
    p = cut(p.select(*at, F.monotonically_increasing_id().alias("_row"), "_lon", "_lat"))
    hits = cut(_match_blocks(p, n_keep + 1, targets, T.StructType([*schema.fields[:n_keep], T.StructField("_row", T.LongType()), *schema.fields[n_keep:]]), block_targets, group_points))
    near, inside = hits.where("kind = 'point'"), hits.where("kind = 'region'")
    first = [F.any_value(c).alias(c) for c in at]
    inside = inside.groupBy("_row").agg(*first, F.min("target_id").alias("target_id")) if first_region else inside.groupBy("_row", "target_id").agg(*first)
    out = near.select(*at, "kind", "target_id").unionByName(inside.select(*at, F.lit("region").alias("kind"), "target_id"))
    if outer:
        none = p.join(hits.select("_row").distinct(), "_row", "left_anti")
        out = out.unionByName(none.select(*at, F.lit(None).cast("string").alias("kind"), F.lit(None).cast("bigint").alias("target_id")))
    return out


def _match_blocks(p: DataFrame, n_keep: int, targets: DataFrame, schema: T.StructType, block_targets: int, group_points: int) -> DataFrame:
    spark = p.sparkSession

    def box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = _targets(*(b.column(k).to_pylist() for k in range(3)))
            lo = np.full((b.num_rows, 5), np.inf)
            hi = np.full((b.num_rows, 5), -np.inf)
            region = np.array([k == "region" for k in b.column(1).to_pylist()], dtype=bool)
            lo[region, :2], hi[region, :2] = t.tri_tree.box_lo, t.tri_tree.box_hi
            lo[~region, 2:], hi[~region, 2:] = t.disc_tree.box_lo, t.disc_tree.box_hi
            mid = (np.where(np.isfinite(lo), lo, 0.0) + np.where(np.isfinite(hi), hi, 0.0)) / 2
            # Morton order of the middle; the two kinds come apart first
            scaled = np.clip(np.c_[(mid[:, :2] + [180, 90]) / [360, 180], (mid[:, 2:] + 1) / 2] * 2**16, 0, 2**16 - 1).astype(np.uint64)
            code = np.zeros(b.num_rows, np.uint64)
            for bit in range(12):
                for axis in range(5):
                    code |= ((scaled[:, axis] >> np.uint64(4 + bit)) & np.uint64(1)) << np.uint64(bit * 5 + axis)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((~region).astype(np.int8)), pa.array(code.astype(np.int64)), pa.array(list(lo), pa.list_(pa.float64())), pa.array(list(hi), pa.list_(pa.float64()))], ["target_id", "kind", "g", "side", "code", "lo", "hi"])

    boxed = targets.mapInArrow(box, f"{_TARGET}, side tinyint, code bigint, lo array<double>, hi array<double>")
    n = targets.count()
    blocks = cut(boxed.repartitionByRange(max(2, -(-n // block_targets)), "side", "code", "target_id", F.xxhash64("g")).withColumn("block", F.spark_partition_id()))
    ends = blocks.groupBy("block").agg(*[F.min(F.col("lo")[k]).alias(f"l{k}") for k in range(5)], *[F.max(F.col("hi")[k]).alias(f"h{k}") for k in range(5)]).collect()  # one row per block
    b_ids = np.array([r[0] for r in ends], dtype=np.int64)
    lo, hi = np.array([[r[1 + k] for k in range(5)] for r in ends]), np.array([[r[6 + k] for k in range(5)] for r in ends])
    lo, hi = np.where(lo > hi, np.inf, lo), np.where(lo > hi, -np.inf, hi)
    flat, ball = np.isfinite(lo[:, 0]), np.isfinite(lo[:, 2])
    sent = spark.sparkContext.broadcast((b_ids[flat], Bvh(lo[flat][:, :2], hi[flat][:, :2]), b_ids[ball], Bvh(lo[ball][:, 2:], hi[ball][:, 2:])))
    ids = schema.names[:n_keep]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f_ids, f_tree, s_ids, s_tree = sent.value
        for b in batches:
            lon, lat = _coords(b, n_keep)
            fa, fj = f_tree.candidates(np.stack([lon, lat], axis=1))
            sa, sj = s_tree.candidates(_unit(lon, lat))
            pairs = np.unique(np.c_[np.r_[fa, sa], np.r_[f_ids[fj], s_ids[sj]]], axis=0)
            idx = pa.array(pairs[:, 0])
            yield pa.RecordBatch.from_arrays([*[c.take(idx) for c in b.columns], pa.array(pairs[:, 1])], [*b.schema.names, "block"])

    routed = cut(p.mapInArrow(route, T.StructType([*p.schema.fields, T.StructField("block", T.LongType())])))
    sizes = [(r["block"], -(-r["count"] // group_points)) for r in routed.groupBy("block").count().collect()]  # one row per block
    salts = lambda: F.broadcast(spark.createDataFrame(sizes, "block bigint, salts int"))
    left = routed.join(salts(), "block").withColumn("salt", F.pmod(F.col("_row"), F.col("salts")).cast("int"))
    right = blocks.select(F.col("block").cast("bigint").alias("block"), "target_id", "kind", "g").join(salts(), "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        t = _targets(*(b.column(c).to_pylist() for c in ("target_id", "kind", "g")))
        batch = pa.RecordBatch.from_arrays([a.column(c).combine_chunks() for c in [*ids, "_lon", "_lat"]], [*ids, "_lon", "_lat"])
        return pa.Table.from_batches([_emit(batch, n_keep, t.match(*_coords(batch, n_keep), False))])

    return left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInArrow(meet, schema)
