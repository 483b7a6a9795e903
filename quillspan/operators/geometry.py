"""Plane geometry and bounding-volume hierarchies in NumPy: ear clipping, exact triangle tests, batched tree descent."""

from __future__ import annotations

import json
from fractions import Fraction

import numpy as np

# ---------------------------------------------------------------- exact orientation


def orient(ax, ay, bx, by, cx, cy) -> int:
    """Sign of the turn a-b-c, exact for all finite doubles."""
    left, right = (ax - cx) * (by - cy), (ay - cy) * (bx - cx)
    det = left - right
    if abs(det) > 4e-16 * (abs(left) + abs(right)) and abs(det) > 1e-290:
        return 1 if det > 0 else -1
    ax, ay, bx, by, cx, cy = map(Fraction, (ax, ay, bx, by, cx, cy))
    det = (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)
    return (det > 0) - (det < 0)


def orient_many(ax, ay, bx, by, cx, cy) -> np.ndarray:
    """As orient, for arrays: doubles first, rational numbers for the few that are too close to call."""
    left, right = (ax - cx) * (by - cy), (ay - cy) * (bx - cx)
    det = left - right
    out = np.sign(det).astype(np.int8)
    unsure = np.flatnonzero(~((np.abs(det) > 4e-16 * (np.abs(left) + np.abs(right))) & (np.abs(det) > 1e-290)))
    for j in unsure:
        v = [float(x[j]) for x in (ax, ay, bx, by, cx, cy)]
        out[j] = orient(*v) if np.isfinite(v).all() else 0
    return out


# ---------------------------------------------------------------- triangulation


def _clean(ring: list) -> list:
    pts = [(float(p[0]), float(p[1])) for p in ring]
    out = [p for i, p in enumerate(pts) if i == 0 or p != pts[i - 1]]
    while len(out) > 1 and out[0] == out[-1]:
        out.pop()
    return out


def _area2(ring: list) -> Fraction:
    f = [(Fraction(x), Fraction(y)) for x, y in ring]
    return sum((a[0] * b[1] - b[0] * a[1] for a, b in zip(f, f[1:] + f[:1])), Fraction(0))


def _crosses(p, q, a, b) -> bool:
    """Segments p-q and a-b meet anywhere but in a shared end point."""
    if {p, q} & {a, b}:
        shared = ({p, q} & {a, b}).pop()
        u, v = (q if p == shared else p), (b if a == shared else a)
        return u != v and orient(*shared, *u, *v) == 0 and (u[0] - shared[0]) * (v[0] - shared[0]) + (u[1] - shared[1]) * (v[1] - shared[1]) > 0
    if max(p[0], q[0]) < min(a[0], b[0]) or max(a[0], b[0]) < min(p[0], q[0]) or max(p[1], q[1]) < min(a[1], b[1]) or max(a[1], b[1]) < min(p[1], q[1]):
        return False
    return orient(*p, *q, *a) * orient(*p, *q, *b) <= 0 and orient(*a, *b, *p) * orient(*a, *b, *q) <= 0


def _in_cone(before, at, after, p) -> bool:
    """The direction from ``at`` to ``p`` runs inside the (counter-clockwise) ring at this corner."""
    if orient(*at, *after, *before) >= 0:
        return orient(*at, *p, *before) > 0 and orient(*p, *at, *after) > 0
    return not (orient(*at, *p, *after) >= 0 and orient(*p, *at, *before) >= 0)


def _bridge(outer: list, hole: list, others: list[list]) -> list:
    """Joins a hole to the outer ring along a segment that crosses no ring: from its rightmost corner that has one, to the nearest corner possible."""
    o = np.array(outer)
    ends = [np.array(r) for r in (outer, hole, *others)]
    a, b = np.concatenate(ends), np.concatenate([np.roll(r, -1, axis=0) for r in ends])
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    for j in sorted(range(len(hole)), key=lambda k: -hole[k][0]):
        h = hole[j]
        for i in np.argsort(((o - h) ** 2).sum(axis=1), kind="stable").tolist():
            p = outer[i]
            if not _in_cone(outer[i - 1], p, outer[(i + 1) % len(outer)], h):
                continue
            near = np.flatnonzero((lo[:, 0] <= max(p[0], h[0])) & (hi[:, 0] >= min(p[0], h[0])) & (lo[:, 1] <= max(p[1], h[1])) & (hi[:, 1] >= min(p[1], h[1])))
            if not any(_crosses(p, h, tuple(a[k].tolist()), tuple(b[k].tolist())) for k in near):
                return outer[: i + 1] + hole[j:] + hole[: j + 1] + outer[i:]
    raise ValueError("a hole can't be joined to its outer ring")


class _Corners:
    """The corners of a ring that can lie in an ear: the ones that don't turn left, found by cells of a grid, or all at once for large boxes."""

    def __init__(self, pts: np.ndarray):
        self.pts, self.live = pts, np.zeros(len(pts), bool)
        self.side = max(1, int(len(pts) ** 0.5))
        self.lo = pts.min(axis=0)
        size = np.maximum(pts.max(axis=0) - self.lo, 1e-300)
        self.scale = self.side / size
        self.cell = np.clip((pts - self.lo) * self.scale, 0, self.side - 1).astype(int).tolist()
        self.held: dict[tuple[int, int], set[int]] = {}

    def put(self, i: int, there: bool) -> None:
        if there != self.live[i]:
            self.live[i] = there
            at = self.held.setdefault(tuple(self.cell[i]), set())
            (at.add if there else at.discard)(i)

    def within(self, x0: float, y0: float, x1: float, y1: float) -> list[int]:
        c0, c1 = np.clip((np.array([[x0, y0], [x1, y1]]) - self.lo) * self.scale, 0, self.side - 1).astype(int).tolist()
        if (c1[0] - c0[0] + 1) * (c1[1] - c0[1] + 1) <= 64:
            return [i for u in range(c0[0], c1[0] + 1) for v in range(c0[1], c1[1] + 1) for i in self.held.get((u, v), ())]
        p = self.pts
        return np.flatnonzero(self.live & (p[:, 0] >= x0) & (p[:, 0] <= x1) & (p[:, 1] >= y0) & (p[:, 1] <= y1)).tolist()


def ear_clip(rings: list[list]) -> list[tuple]:
    """Triangles (ax, ay, bx, by, cx, cy), counter-clockwise, that tile the polygon whose first ring is its border and the rest its holes.

    Rings may run either way, be concave and be closed or not; fewer than three distinct points give no triangle. No point is moved,
    so with exact tests a point is in a triangle exactly if it is in the closed polygon. Rings that cross are a ValueError.
    """
    rings = [r for r in map(_clean, rings)]
    if not rings or len(rings[0]) < 3:
        return []
    outer = rings[0] if _area2(rings[0]) > 0 else rings[0][::-1]
    holes = [r if _area2(r) < 0 else r[::-1] for r in rings[1:] if len(r) >= 3]
    holes.sort(key=lambda r: -max(r)[0])
    for k, h in enumerate(holes):
        outer = _bridge(outer, h, holes[k + 1 :])
    n = len(outer)
    before, after = [(i - 1) % n for i in range(n)], [(i + 1) % n for i in range(n)]
    corners = _Corners(np.array(outer))
    turn = lambda i: orient(*outer[before[i]], *outer[i], *outer[after[i]])
    for i in range(n):
        corners.put(i, turn(i) <= 0)

    def is_ear(i: int) -> bool:
        a, b, c = outer[before[i]], outer[i], outer[after[i]]
        for k in corners.within(min(a[0], b[0], c[0]), min(a[1], b[1], c[1]), max(a[0], b[0], c[0]), max(a[1], b[1], c[1])):
            p = outer[k]
            if p != a and p != b and p != c and orient(*a, *b, *p) >= 0 and orient(*b, *c, *p) >= 0 and orient(*c, *a, *p) >= 0:
                return False
        return True

    def drop(i: int) -> None:
        u, v = before[i], after[i]
        after[u], before[v] = v, u
        corners.put(i, False)
        for w in (u, v):
            corners.put(w, turn(w) <= 0)

    out, i, left, missed = [], 0, n, 0
    while left > 2:
        a, b, c = outer[before[i]], outer[i], outer[after[i]]
        o = orient(*a, *b, *c)
        # without an area, a corner flat between its neighbours or a spike goes at once, another one only if nothing else can
        flat = o == 0 and (missed > left or a == c or (min(a[0], c[0]) <= b[0] <= max(a[0], c[0]) and min(a[1], c[1]) <= b[1] <= max(a[1], c[1])))
        if flat or (o > 0 and is_ear(i)):
            if not flat:
                out.append((*a, *b, *c))
            drop(i)
            left, missed, i = left - 1, 0, after[after[i]]  # the next corner but one, lest a fan of slivers arise
        else:
            i, missed = after[i], missed + 1
            if missed > 2 * left + 1:
                raise ValueError("the ring crosses itself")
    tiled, whole = sum(_area2([t[0:2], t[2:4], t[4:6]]) for t in out), abs(_area2(rings[0])) - sum(abs(_area2(h)) for h in holes)
    if abs(tiled - whole) > abs(whole) * Fraction(1, 10**9):
        raise ValueError("the ring crosses itself")
    return out


def _polygons(g) -> list:
    kind = g.get("type") if isinstance(g, dict) else None
    if kind == "Feature":
        return _polygons(g.get("geometry"))
    if kind == "GeometryCollection":
        return [p for x in g.get("geometries") or [] for p in _polygons(x)]
    return {"Polygon": lambda: [g["coordinates"]], "MultiPolygon": lambda: g["coordinates"]}.get(kind, list)()


def triangulate(text: str | None) -> tuple[list[tuple], str | None]:
    """Triangles of a GeoJSON Polygon, MultiPolygon, Feature or GeometryCollection, and why there are none: ``no polygon`` or what is wrong with it."""
    try:
        parts = _polygons(json.loads(text)) if text else []
    except (ValueError, KeyError, AttributeError):
        parts = []
    try:
        out = [t for rings in parts for t in ear_clip(rings)]
    except ValueError as e:
        return [], str(e)
    except (TypeError, IndexError, KeyError, OverflowError):
        return [], "broken coordinates"
    return out, None if out else "no polygon"


def geojson_triangles(text: str | None) -> list[tuple]:
    """The triangles alone; a broken geometry has none."""
    return triangulate(text)[0]


def geojson_area(text: str | None) -> float | None:
    """Area in plane coordinates, holes taken off; null if there is no sound polygon."""
    out, why = triangulate(text)
    return None if why else float(sum(_area2([t[0:2], t[2:4], t[4:6]]) for t in out) / 2)


# ---------------------------------------------------------------- bounding-volume hierarchy


class Bvh:
    """Binary tree of boxes over n boxes in d dimensions, split at the median of the widest axis; leaves hold up to ``leaf`` boxes."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, leaf: int = 4):
        n = len(lo)
        mid = (lo + hi) / 2
        self.order = np.arange(n)
        los, his, first, count, kids = [], [], [], [], []
        todo = [(0, n, -1, 0)] if n else []
        while todo:
            a, b, parent, side = todo.pop()
            me = len(los)
            if parent >= 0:
                kids[parent][side] = me
            part = self.order[a:b]
            los.append(lo[part].min(axis=0)), his.append(hi[part].max(axis=0)), first.append(a), count.append(b - a), kids.append([-1, -1])
            if b - a > leaf:
                axis = int(np.argmax(mid[part].max(axis=0) - mid[part].min(axis=0)))
                self.order[a:b] = part[np.argsort(mid[part, axis], kind="stable")]
                m = (a + b) // 2
                todo += [(a, m, me, 0), (m, b, me, 1)]
        d = lo.shape[1]
        self.lo, self.hi = np.array(los).reshape(-1, d), np.array(his).reshape(-1, d)
        self.first, self.count, self.kids = np.array(first, dtype=np.int64), np.array(count, dtype=np.int64), np.array(kids, dtype=np.int64).reshape(-1, 2)
        self.box_lo, self.box_hi = lo, hi

    def candidates(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (point index, box index) of every box that holds the point, border included; all points descend a level at a time."""
        at, box = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(self.lo) and len(p):
            pts, nodes = np.arange(len(p)), np.zeros(len(p), np.int64)
            while len(pts):
                x = p[pts]
                keep = ((x >= self.lo[nodes]) & (x <= self.hi[nodes])).all(axis=1)
                pts, nodes = pts[keep], nodes[keep]
                leaf = self.kids[nodes, 0] < 0
                lp, ln = pts[leaf], nodes[leaf]
                if len(lp):
                    c = self.count[ln]
                    rep = np.repeat(np.arange(len(lp)), c)
                    b = self.order[self.first[ln][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(c) - c, c)]
                    q = p[lp[rep]]
                    hit = ((q >= self.box_lo[b]) & (q <= self.box_hi[b])).all(axis=1)
                    at.append(lp[rep][hit]), box.append(b[hit])
                pts, nodes = np.repeat(pts[~leaf], 2), self.kids[nodes[~leaf]].ravel()
        return np.concatenate(at), np.concatenate(box)
