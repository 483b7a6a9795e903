"""Grids of binary classification trees, searched on weighted distinct rows with as few trees as the grid really has.

Three facts save most fits, and none changes a model's distribution: equal rows act as one row with a weight, if the weight's share in a fold is multinomial and its share in a bootstrap is
Poisson of the weight; a tree cut at a lower depth is the tree grown to that depth; the first trees of a forest are a forest. Values of maxBins that give the same candidate splits share their trees.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Trees grown in a task at most.
TREES = 5
#: Counters of a level that are held at once (beyond it, nodes are taken in turn).
COUNTERS = 2_000_000


def fold_weights(weights: np.ndarray, folds: int, seed: int) -> np.ndarray:
    """(rows, folds): how many of each row's repeats fall into each fold, as if every repeat drew its fold."""
    return np.random.default_rng(seed).multinomial(weights.astype(np.int64), [1 / folds] * folds)


def candidates(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """Spark's thresholds of a continuous feature, counted over all rows instead of a sample: midpoints of all distinct values, or ``most - 1`` at equal strides of weight."""
    distinct, at = np.unique(values, return_inverse=True)
    if len(distinct) <= most:
        return (distinct[:-1] + distinct[1:]) / 2
    held = np.bincount(at, weights)
    upto, stride, chosen = np.cumsum(held), held.sum() / most, []
    target = stride
    for i in range(1, len(distinct)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            chosen.append((distinct[i - 1] + distinct[i]) / 2)
            target += stride
    return np.array(chosen)


def _impurity(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    n = a + b
    p, q = a / n, b / n
    if kind == "gini":
        return 1.0 - p * p - q * q
    with np.errstate(divide="ignore", invalid="ignore"):
        return -np.where(p > 0, p * (np.log(p) / np.log(2.0)), 0.0) - np.where(q > 0, q * (np.log(q) / np.log(2.0)), 0.0)


class Tree:
    """A binary classification tree grown level by level on binned rows; the levels in ``depths`` remember which node each row (also of weight 0) had come to."""

    def __init__(self, x: np.ndarray, bins: np.ndarray, y: np.ndarray, w: np.ndarray, kind: str, depths: Sequence[int], subset: int, rng: np.random.Generator):
        n, p = x.shape
        node, rows, train = np.zeros(n, np.int64), np.arange(n), np.flatnonzero(w > 0)
        stats, level = np.array([[w[y == 0].sum(), w[y == 1].sum()]]), 0
        self.kind, self.stats, self.left, self.parent, self.first, self.at = kind, [stats], [], [np.array([-1])], [0], {}
        self.splits: list[np.ndarray] = []  # per level: feature, bin and gain of the nodes that are split
        base, total = 0, 1
        while True:
            k = len(stats)
            left = np.full(k, -1)
            self.left.append(left)
            self.splits.append(np.full((3, k), -1.0))
            live = np.flatnonzero((stats > 0).all(axis=1)) if level < max(depths) else np.empty(0, np.int64)
            if level in depths:
                self.at[level] = node.copy()
            if not len(live):
                break
            place = np.full(k, -1)
            place[live] = np.arange(len(live))
            rows, train = rows[place[node[rows] - base] >= 0], train[place[node[train] - base] >= 0]
            chosen = np.argsort(rng.random((len(live), p)), axis=1)[:, :subset] if subset < p else np.broadcast_to(np.arange(p), (len(live), p))
            at, turn = place[node[train] - base], np.cumsum(bins[chosen].sum(axis=1)) // COUNTERS
            ends = [0, *(np.flatnonzero(np.diff(turn)) + 1), len(live)]
            parts = []
            for lo, hi in zip(ends, ends[1:]):
                own = slice(None) if len(ends) == 2 else (at >= lo) & (at < hi)
                parts.append(self._best(x, bins, y, w, kind, train[own], at[own] - lo, stats[live[lo:hi]], chosen[lo:hi]))
            feature, bin_, gain, lefts = (np.concatenate(v) for v in zip(*parts))
            split = gain > 0
            if not split.any():
                break
            child = np.full(len(live), -1)
            child[split] = total + 2 * np.arange(split.sum())
            left[live] = child
            self.splits[-1][:, live[split]] = feature[split], bin_[split], gain[split]
            below = np.empty((2 * split.sum(), 2))
            below[0::2] = lefts[split]
            below[1::2] = stats[live][split] - lefts[split]
            rows, train = (v[split[place[node[v] - base]]] for v in (rows, train))
            at = place[node[rows] - base]
            node[rows] = child[at] + (x[rows, feature[at]] > bin_[at])
            self.parent.append(np.repeat(base + live[split], 2))
            base, total, stats, level = total, total + len(below), below, level + 1
            self.stats.append(stats)
            self.first.append(base)
        self.at |= {d: node for d in depths if d not in self.at}

    @staticmethod
    def _best(x, bins, y, w, kind, train, at, stats, chosen):
        """Per node: feature and bin of the best split (the first of equal ones), its gain (0: none) and its left side's weight by label."""
        k, m = chosen.shape
        sizes = bins[chosen].ravel()
        start = np.concatenate([[0], np.cumsum(sizes)])
        key = start[:-1].reshape(k, m)[at] + x[train[:, None], chosen[at]]
        held = np.bincount((2 * key + y[train][:, None]).ravel(), np.repeat(w[train], m), 2 * start[-1]).reshape(-1, 2)
        upto = np.cumsum(held, axis=0)  # of whole numbers, so exact
        before = np.vstack([np.zeros(2), upto])[start[:-1]]
        segment = np.repeat(np.arange(k * m), sizes)
        lefts = upto - before[segment]
        n_left, n = lefts.sum(axis=1), stats.sum(axis=1)
        open_ = np.flatnonzero((n_left > 0) & (n_left < n[segment // m]))
        feature, bin_, gain, best = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k), np.zeros((k, 2))
        if len(open_):
            of, a = segment[open_] // m, lefts[open_]
            b = stats[of] - a
            gains = _impurity(stats[:, 0], stats[:, 1], kind)[of] - n_left[open_] / n[of] * _impurity(a[:, 0], a[:, 1], kind) - b.sum(axis=1) / n[of] * _impurity(b[:, 0], b[:, 1], kind)
            begins = np.flatnonzero(np.diff(of, prepend=-1))
            top = np.full(k, -np.inf)
            top[of[begins]] = np.maximum.reduceat(gains, begins)
            winners = np.flatnonzero(gains == top[of])
            winners = winners[np.diff(of[winners], prepend=-1) > 0]
            w_of, e = of[winners], open_[winners]
            feature[w_of], bin_[w_of] = chosen.ravel()[segment[e]], e - start[segment[e]]
            gain[w_of], best[w_of] = np.maximum(gains[winners], 0), lefts[e]
        return feature, bin_, gain, best

    def _ended(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the nodes down to ``depth``, leaves of one parent that predict alike being merged (as Spark does): weights by label, left child, leaf or not, and the node that stands for it."""
        levels = min(depth + 1, len(self.stats))
        stats, left = np.vstack(self.stats[:levels]), np.concatenate(self.left[:levels])
        edges = [*self.first[:levels], len(stats)]
        says, leaf = stats[:, 1] > stats[:, 0], left < 0
        if levels == depth + 1:
            leaf[edges[-2] :] = True
        for lv in range(levels - 2, -1, -1):
            inner = np.arange(edges[lv], edges[lv + 1])
            inner = inner[~leaf[inner]]
            a = left[inner]
            leaf[inner] = leaf[a] & leaf[a + 1] & (says[a] == says[a + 1])
        target = np.arange(len(stats))
        for lv in range(1, levels):
            these = np.arange(edges[lv], edges[lv + 1])
            above = target[self.parent[lv]]
            target[these] = np.where(leaf[above], above, these)
        return stats, left, leaf, target

    def leaf_stats(self, depth: int) -> np.ndarray:
        """The weights by label of each row's leaf in the tree that ends at ``depth``."""
        stats, _, _, target = self._ended(depth)
        return stats[target[self.at[depth]]]

    def nodes(self, depth: int, cuts: list[np.ndarray]) -> dict[str, list]:
        """The tree that ends at ``depth`` as the rows of a model of Spark's saved."""
        stats, left, leaf, target = self._ended(depth)
        kept = np.flatnonzero(target == np.arange(len(stats)))
        number = np.zeros(len(stats), np.int64)
        number[kept] = np.arange(len(kept))
        feature, bin_, gain = np.concatenate(self.splits, axis=1)[:, kept]
        stats, left, leaf = stats[kept], left[kept], leaf[kept]
        child = np.full(len(kept), -1)
        child[~leaf] = number[left[~leaf]]
        return {
            "id": list(range(len(kept))), "prediction": (stats[:, 1] > stats[:, 0]).astype(float).tolist(), "impurity": _impurity(stats[:, 0], stats[:, 1], self.kind).tolist(),
            "impurityStats": stats.tolist(), "rawCount": stats.sum(axis=1).astype(int).tolist(), "gain": np.where(leaf, -1.0, gain).tolist(), "leftChild": child.tolist(),
            "rightChild": np.where(leaf, -1, child + 1).tolist(), "featureIndex": np.where(leaf, -1, feature).astype(int).tolist(),
            "threshold": [[] if end else [float(cuts[int(f)][int(c)])] for end, f, c in zip(leaf, feature, bin_)],
        }


def area_under_roc(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """By the trapezoid rule over all distinct scores; with one label only, 0 or 1 as in Spark's curve."""
    _, at = np.unique(score, return_inverse=True)
    pos, neg = (np.cumsum(np.bincount(at, w * (y == c))[::-1]) for c in (1, 0))
    pos, neg = (np.concatenate([[0.0], v / v[-1] if v[-1] else np.full(len(v), float(c)), [1.0]]) for v, c in ((pos, 1), (neg, 0)))
    return float(np.sum(np.diff(neg) * (pos[1:] + pos[:-1]) / 2))


def splits_of(x: np.ndarray, w: np.ndarray, most: int) -> list[np.ndarray]:
    """Each feature's candidate splits by the rows of positive weight."""
    most, held = min(most, int(w.sum())), w > 0
    return [candidates(c[held], w[held], most) for c in x.T]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows' bins, bins of each feature)."""
    return np.column_stack([np.searchsorted(c, v).astype(np.int32) for c, v in zip(cuts, x.T)]), np.array([len(c) + 1 for c in cuts])


def bag(w: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A bootstrap of all repeats: as many of each row as if its repeats were drawn one by one."""
    return rng.poisson(w).astype(float)


def votes(x: np.ndarray, y: np.ndarray, w: np.ndarray, test: np.ndarray, kind: str, most: int, depths: Sequence[int], trees: Iterable[int], subset: int, forest: bool, seed: Sequence[int]) -> np.ndarray:
    """(depths, rows of ``test``): summed scores of the trees grown on rows of weight ``w``. A single tree scores by the label's weight in the leaf, a forest's by its share, as Spark's do."""
    xb, bins = binned(x, splits_of(x, w, most))
    out = np.zeros((len(depths), len(test)))
    for t in trees:
        rng = np.random.default_rng([*seed, t])
        tree = Tree(xb, bins, y, bag(w, rng) if forest else w, kind, depths, subset, rng)
        for i, d in enumerate(depths):
            s = tree.leaf_stats(d)[test]
            out[i] += s[:, 1] / np.maximum(s.sum(axis=1), 1) if forest else s[:, 1]
    return out


def shared(grid: dict, distinct: int, columns: int, forest: bool) -> dict[tuple, tuple]:
    """The combinations of a grid (impurity, maxBins, maxDepth, numTrees) -> (impurity, maxBins, features tried at a node) whose trees serve them.

    From ``distinct``, the most distinct values of a feature, on, all values of maxBins split alike.
    """
    enough = [b for b in grid["maxBins"] if b >= distinct]
    subset = lambda n: int(np.ceil(np.sqrt(columns))) if forest and n > 1 else columns
    return {(i, b, d, n): (i, min(enough) if b in enough else b, subset(n)) for i in grid["impurity"] for b in grid["maxBins"] for d in grid["maxDepth"] for n in grid["numTrees"]}


def search(spark: SparkSession, x: np.ndarray, y: np.ndarray, n: np.ndarray, grid: dict, forest: bool, folds: int, seed: int) -> dict[tuple, float]:
    """(impurity, maxBins, maxDepth, numTrees) -> mean area under ROC over the folds; row i of ``x`` stands for ``n[i]`` rows. Every group of trees is grown in tasks of a few trees."""
    serves = shared(grid, max(len(np.unique(c)) for c in x.T), x.shape[1], forest)
    depths, tasks = sorted(set(grid["maxDepth"])), []
    for g in dict.fromkeys(serves.values()):
        counts = sorted({k[3] for k, v in serves.items() if v == g})
        starts = sorted({0, *counts[:-1], *range(0, counts[-1], TREES)})
        tasks += [(*g, fold, lo, hi, counts) for fold in range(folds) for lo, hi in zip(starts, [*starts[1:], counts[-1]])]
    tasks.sort(key=lambda t: t[4] - t[5])
    data = spark.sparkContext.broadcast((x, y, n.astype(float), fold_weights(n, folds, seed)))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, n, f = data.value
        for i in (i for b in batches for i in b.column(0).to_pylist()):
            kind, most, subset, fold, lo, hi, _ = tasks[i]
            test = np.flatnonzero(f[:, fold])
            v = votes(x, y, n - f[:, fold], test, kind, most, depths, range(lo, hi), subset, forest, [seed, fold])
            yield pa.RecordBatch.from_pydict({"task": [i], "key": ["|".join(map(str, tasks[i][:4]))], "votes": [v.tobytes()]})

    def score(rows: pa.Table) -> pa.Table:
        _, y, _, f = data.value
        upto, out = 0.0, []
        for i, v in sorted(zip(rows["task"].to_pylist(), rows["votes"].to_pylist()), key=lambda r: tasks[r[0]][4]):
            kind, most, subset, fold, _, hi, counts = tasks[i]
            test = np.flatnonzero(f[:, fold])
            upto = upto + np.frombuffer(v).reshape(len(depths), -1)
            if hi in counts:
                out += [(kind, most, subset, d, hi, fold, area_under_roc(upto[j], y[test], f[test, fold])) for j, d in enumerate(depths)]
        return pa.table(dict(zip(("kind", "most", "subset", "depth", "trees", "fold", "area"), map(list, zip(*out)))))

    done = spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(grow, "task long, key string, votes binary").groupBy("key")
    areas: dict[tuple, list[float]] = {}
    for r in done.applyInArrow(score, "kind string, most long, subset long, depth long, trees long, fold long, area double").collect():
        areas.setdefault((r.kind, r.most, r.subset, r.depth, r.trees), []).append((r.fold, r.area))
    data.destroy()
    return {k: float(np.mean([a for _, a in sorted(areas[(*v, k[2], k[3])])])) for k, v in serves.items()}


#: Columns of a saved model's nodes.
NODES = (
    "treeID int, id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, leftChild int, rightChild int, featureIndex int, threshold array<double>"
)


def grown_forest(spark: SparkSession, x: np.ndarray, y: np.ndarray, n: np.ndarray, kind: str, most: int, depth: int, trees: int, subset: int, seed: int) -> DataFrame:
    """treeID, nodeData: the nodes of a forest grown on all rows, a tree in each task, laid out as in Spark's saved models."""
    data = spark.sparkContext.broadcast((x, y, n.astype(float)))
    types = pa.schema([(f.name, {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}.get(f.dataType.simpleString(), pa.list_(pa.float64()))) for f in T.StructType.fromDDL(NODES)])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, n = data.value
        cuts = splits_of(x, n, most)
        xb, bins = binned(x, cuts)
        for t in (t for b in batches for t in b.column(0).to_pylist()):
            rng = np.random.default_rng([seed, t])
            nodes = Tree(xb, bins, y, bag(n, rng), kind, [depth], subset, rng).nodes(depth, cuts)
            yield pa.RecordBatch.from_pydict({"treeID": [t] * len(nodes["id"]), **nodes}, schema=types)

    split = F.struct("featureIndex", F.col("threshold").alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories")).alias("split")
    return spark.range(0, trees, 1, trees).mapInArrow(grow, NODES).select("treeID", F.struct("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", split).alias("nodeData"))
