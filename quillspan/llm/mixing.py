"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is a line of tokens: its documents in random order, then again in another order for the second copy, and so on up to the source's
quota. The lines are cut into blocks of equal tokens, the same for all sources. Each output shard gets the whole number of blocks that its
share of each source comes to, as one stretch of the (randomly ordered) line; the few blocks left over are split by a tree of
multivariate-hypergeometric draws, so that every quota is exact to a block. Which shard holds a block is a formula or, for the left-over ones, a walk
down the tree, whose draws follow from the seed: no table of blocks exists anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, small_or_plain

#: Tokens per output shard, if the number of shards is not given; so few that one task can put them in order.
SHARD_TOKENS = 4 << 20
#: Least number of whole blocks a shard gets of its smallest source, and documents per task that puts a line in order.
MIN_BLOCKS, LINE_DOCS = 40, 100_000
#: Most targets, which the driver plans with, and most left-over blocks in all, which the draws can hold.
MAX_TARGETS, MAX_LEFT = 10_000, 10**9 - 1


class SplitTree:
    """Splits ``counts`` (one per source) over shards: each node draws what goes to its left half, from the seed and its own place alone."""

    def __init__(self, counts, shards: int, seed: int):
        self.counts, self.shards, self.seed = np.asarray(counts, np.int64), shards, seed
        self._drawn: dict[tuple[int, int], np.ndarray] = {}

    def left(self, lo: int, hi: int, have: np.ndarray) -> np.ndarray:
        got = self._drawn.get((lo, hi))
        if got is None:
            if len(self._drawn) > 200_000:
                self._drawn.clear()
            total, mid = int(have.sum()), (lo + hi) // 2
            n = -(-total * (mid - lo) // (hi - lo))
            rng = np.random.default_rng([self.seed, lo, hi])
            got = self._drawn[(lo, hi)] = rng.multivariate_hypergeometric(have, n, method="marginals") if total else have * 0
        return got

    def shard(self, source: int, block: int) -> int:
        """The shard of a source's left-over block, blocks being numbered from 0."""
        lo, hi, have = 0, self.shards, self.counts
        while hi - lo > 1:
            left, mid = self.left(lo, hi, have), (lo + hi) // 2
            if block < left[source]:
                hi, have = mid, left
            else:
                lo, have, block = mid, have - left, block - int(left[source])
        return lo


def split_quotas(counts, shards: int, seed: int) -> np.ndarray:
    """shards x sources: exact quotas of each shard, whose sums over the shards are ``counts`` and whose sums over the sources differ by at most one."""
    tree, out = SplitTree(counts, shards, seed), np.zeros((shards, len(counts)), np.int64)

    def walk(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        left, mid = tree.left(lo, hi, have), (lo + hi) // 2
        walk(lo, mid, left)
        walk(mid, hi, have - left)

    walk(0, shards, tree.counts)
    return out


def _norm(c):
    return F.lower(F.regexp_replace(c, r"\A[\s\p{Z}]+|[\s\p{Z}]+\z", ""))


def quotas(sizes: dict[str, int], targets: list[tuple], total: int | None = None) -> dict[str, float]:
    """source -> tokens of the largest mixture in which every named source with documents holds its share (or of ``total`` tokens if that is less).

    ``sizes`` are the sources' tokens, ``targets`` rows of (source, share, most copies); targets without documents give their share to the others.
    """
    want: dict[str, tuple[float, int]] = {}
    for source, share, repeats in targets:
        name = (source or "").strip().lower()
        if name in sizes and (share or 0) > 0 and (repeats or 0) > 0:
            s, r = want.get(name, (0.0, 0))
            want[name] = (s + float(share), max(r, int(repeats)))
    whole = sum(s for s, _ in want.values())
    largest = min((sizes[n] * r * whole / s for n, (s, r) in want.items()), default=0.0)
    goal = min(float(total), largest) if total is not None else largest
    return {n: goal * want[n][0] / whole for n in sorted(want)}


def mix(
    documents: DataFrame, doc: str, text: str, source: str, targets: DataFrame, total_tokens: int | None = None, shards: int | None = None, seed: int = 17,
    shard_tokens: int = SHARD_TOKENS, min_blocks: int = MIN_BLOCKS, line_docs: int = LINE_DOCS,
) -> DataFrame:
    """doc, source, copy (from 1), shard, place (from 1 within the shard), n_tokens: the documents of the mixture, each at most max_repeats times.

    ``targets`` holds source, target_share and max_repeats (at most MAX_TARGETS rows, more are an error). Source names are compared trimmed and in
    lower case; sources without documents give their share to the others in proportion. The mixture is the largest whose shares can be held
    (or ``total_tokens`` if that is less), in ``shards`` (or one per ``shard_tokens``): every copy before the last is the whole source, the last one takes documents in random order until the
    quota is met, the document that reaches it included. Every shard holds the same shares to a block and a document of each source. Documents without
    text, source or target are not used; repeated ids are documents of their own; a null id is kept as it is. Sizes are bytes of UTF-8.
    """
    d = documents.select(F.col(doc).alias("id"), _norm(F.col(source)).alias("source"), F.octet_length(text).cast("bigint").alias("n_tokens"), F.xxhash64(doc, text).alias("u"))
    # rows without an id are told apart by their number, lest equal ones meet in one place of the order
    d = d.where("n_tokens > 0 and source is not null").withColumn("u", F.when(F.col("id").isNull(), F.xxhash64("u", F.monotonically_increasing_id())).otherwise(F.col("u")))
    d = cut(d)
    rows = [tuple(r) for r in targets.select("source", "target_share", "max_repeats").limit(MAX_TARGETS + 1).collect()]
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    named = sorted({(r[0] or "").strip().lower() for r in rows})
    sizes = {r["source"]: (int(r["n"]), int(r["docs"])) for r in d.where(F.col("source").isin(named)).groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect()}  # one row per target
    quota = {s: q for s, q in quotas({s: n for s, (n, _) in sizes.items()}, rows, total_tokens).items() if q >= 0.5}
    empty = d.where("false").select(F.col("id").alias(doc), "source", *[F.lit(0).alias(c) for c in ("copy", "shard", "place")], "n_tokens")
    if not quota:
        return empty
    live, goal = list(quota), sum(quota.values())
    # fewer than one block per shard and source is left over
    if (shards or 1) * len(live) > MAX_LEFT:
        raise ValueError("too many shards for so many sources")
    shards = shards or max(1, min(-(-int(goal) // shard_tokens), MAX_LEFT // len(live)))
    per_shard = -(-min_blocks * goal // min(quota.values()))  # blocks, of all sources
    blocks = {s: max(1, round(q / goal * shards * per_shard)) for s, q in quota.items()}
    base = {s: n // shards for s, n in blocks.items()}
    tree = (np.array([blocks[s] - base[s] * shards for s in live]), shards, seed)
    pick = lambda values, kind="bigint": F.element_at(F.create_map(*[x for s in live for x in (F.lit(s), F.lit(values[s]).cast(kind))]), F.col("source"))

    # the lines: documents of all copies, in order within buckets of hash ranges, and the buckets' tokens before them
    size = {s: sizes[s][0] for s in live}
    copies = {s: int(-(-q // size[s])) for s, q in quota.items()}
    buckets = {s: max(1, -(-sizes[s][1] // line_docs)) for s in live}
    h = d.where(F.col("source").isin(live)).withColumn("copy", F.explode(F.sequence(F.lit(1), pick(copies, "int"))))
    h = h.withColumn("h", F.xxhash64("u", "copy", F.lit(seed))).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), pick(buckets)))
    whole = h.groupBy("source", "copy", "bucket").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy("source", "copy").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = cut(whole.withColumn("first", F.coalesce(F.sum("n").over(upto), F.lit(0)) + (F.col("copy") - 1) * pick(size)).where(F.col("first") < pick(quota, "double")).drop("n"))
    line = h.join(small_or_plain(first), ["source", "copy", "bucket"])
    within = Window.partitionBy("source", "copy", "bucket").orderBy("h", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("first") + F.sum("n_tokens").over(within) - F.col("n_tokens")
    used = line.withColumn("start", start).where(F.col("start") < pick(quota, "double")).select("id", "source", "copy", "n_tokens", "u", "start")

    # the shard: a stretch of whole blocks each, what is left over by the tree
    # a document belongs to the block that holds its middle, so a shard is off by half a document at most at either end
    block = F.least(F.floor((F.col("start") + F.col("n_tokens") / 2) / (pick(quota, "double") / pick(blocks))), pick(blocks) - 1)
    b = used.withColumn("block", block).withColumn("over", F.col("block") - pick(base) * shards)
    placed = b.withColumn("shard", F.when(F.col("over") < 0, F.floor(F.col("block") / pick(base))))

    def by_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, number = SplitTree(*tree), {s: k for k, s in enumerate(live)}
        for x in batches:
            at = [sh if sh is not None else t.shard(number[s], o) for s, o, sh in zip(x.column(1).to_pylist(), x.column(4).to_pylist(), x.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*x.columns[:4], pa.array(at, pa.int64()), x.column(6)], ["id", "source", "copy", "n_tokens", "shard", "u"])

    id_type = d.schema["id"].dataType.simpleString()
    cols = f"id {id_type}, source string, copy int, n_tokens bigint, shard bigint, u bigint"
    settled = placed.where("over < 0").select("id", "source", "copy", "n_tokens", "shard", "u")
    rest = placed.where("over >= 0").select("id", "source", "copy", "n_tokens", "over", F.lit(None).cast("bigint").alias("shard"), "u").mapInArrow(by_tree, cols)
    mixed = settled.unionByName(rest) if tree[0].any() else settled

    # shuffled within the shard: in order within buckets again, and the buckets' rows before them
    per = max(1, -(-sum(copies[s] * sizes[s][1] for s in live) // (shards * line_docs)))
    mixed = cut(mixed.withColumn("h", F.xxhash64("u", "copy", F.lit(seed + 1))).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(per))))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = mixed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("shard", "bucket").orderBy("h", "id", "copy", "n_tokens")
    out = mixed.join(small_or_plain(cut(starts)), ["shard", "bucket"]) if per > 1 else mixed.withColumn("first", F.lit(0))
    return out.withColumn("place", (F.col("first") + F.row_number().over(order)).cast("int")).select(F.col("id").alias(doc), "source", "copy", F.col("shard").cast("int").alias("shard"), "place", "n_tokens")


def reached_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, n_docs, n_tokens, actual_share, most_copies: one row per target, also for sources without documents."""
    got = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("copy").alias("most_copies"))
    all_tokens = got.agg(F.sum("n_tokens").alias("all"))  # one row
    t = targets.groupBy(_norm(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return t.join(got, "source", "left").join(F.broadcast(all_tokens)).select(
        "source", "target_share", "max_repeats", zero("n_docs"), zero("n_tokens"), F.coalesce(F.col("n_tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"), zero("most_copies")
    )


def shard_shares(mixed: DataFrame) -> DataFrame:
    """shard, source, n_docs, n_tokens, share: what each shard holds of each source, and the part that is of the shard."""
    got = mixed.groupBy("shard", "source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return got.withColumn("share", F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy("shard")))
