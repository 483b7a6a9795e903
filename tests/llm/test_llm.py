"""Operators for training collections: SQL on the smallest tables, brute force, round trips, nulls, empty tables, ties and repeats."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import SF, same

from quillspan.llm import queries as Q
from quillspan.llm.chunking import WINDOW, cut_points, split_oversized, strengths
from quillspan.llm.distinctive import distinctive_terms, top_terms
from quillspan.llm.frequency import term_frequencies
from quillspan.llm.mixing import SplitTree, mix, reached_shares, shard_shares, split_quotas
from quillspan.llm.packing import best_fit, pack
from quillspan.llm.terms import word_terms


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, name):
    same(spark, Q.QUERIES[name], Q.SQL[name])


# ------------------------------------------------------------------ terms

LISTS = [(1, "List(a, b,  A )"), (1, "List(a, b,  A )"), (2, "[b, , c]"), (3, None), (4, ""), (5, " "), (6, "List()"), (7, "b"), (8, "WrappedArray(c, d\n)"), (None, "zzz"), (9, "x(y), b")]


def test_term_frequencies(spark):
    df = spark.createDataFrame([(*r, "clash") for r in LISTS], "id bigint, f string, term string")
    got = {r.term: (r.occurrences, r.records, r.mark) for r in term_frequencies(df, "id", "f", rare_below=2, common_above=0.5).collect()}
    assert got == {"a": (2, 1, "rare"), "b": (4, 4, "common"), "c": (2, 2, None), "d": (1, 1, "rare"), "x(y)": (1, 1, "rare")}
    assert term_frequencies(df.where("false"), "id", "f").count() == 0
    one = spark.createDataFrame([(1, "w," * 50_000)], "id bigint, f string")
    assert [(r.term, r.occurrences) for r in term_frequencies(one, "id", "f").collect()] == [("w", 50_000)]


def test_distinctive_terms_against_brute_force(spark):
    docs = {1: "red red blue", 2: "blue green", 3: "blue", 4: "Blue, GREEN green x1", 5: "!!"}
    df = spark.createDataFrame([*docs.items(), (1, "red red blue"), (6, None), (7, "  "), (None, "q")], "id bigint, t string").selectExpr("*", "'c' as term")
    got = {(r.id, r.term): r for r in distinctive_terms(df, "id", "t", word_terms, empty_counts=True).collect()}
    words = {i: __import__("re").findall(r"\w+", t.lower()) for i, t in docs.items()}
    n_t, d_t = Counter(w for ws in words.values() for w in ws), Counter(w for ws in words.values() for w in set(ws))
    z = sum(len(ws) ** 0.75 for ws in words.values())
    assert set(got) == {(i, w) for i, ws in words.items() for w in ws}
    for (i, w), r in got.items():
        n, size = words[i].count(w), len(words[i])
        total = sum(n_t.values())
        pmi = math.log(n / total / (n_t[w] / total * size**0.75 / z))
        assert math.isclose(r.pmi, pmi, abs_tol=1e-12) and math.isclose(r.ppmi, max(pmi, 0), abs_tol=1e-12)
        assert math.isclose(r.share_idf, n / size * math.log(5 / d_t[w]), abs_tol=1e-12)
    top = {(r.id, r.term) for r in top_terms(distinctive_terms(df, "id", "t", word_terms, empty_counts=True), "id").collect()}
    assert top == {(1, "red"), (2, "green"), (3, "blue"), (4, "green")}
    assert distinctive_terms(df.where("false"), "id", "t").count() == 0


def test_equal_scores_all_come(spark):
    df = spark.createDataFrame([(1, "a,b"), (2, "c")], "id bigint, f string")
    assert {(r.id, r.term) for r in top_terms(distinctive_terms(df, "id", "f"), "id").collect()} == {(1, "a"), (1, "b"), (2, "c")}
    same_everywhere = spark.createDataFrame([(1, "a"), (2, "a")], "id bigint, f string")
    assert top_terms(distinctive_terms(same_everywhere, "id", "f"), "id").count() == 2


# ------------------------------------------------------------------ containers


def test_best_fit():
    bins = best_fit([5, 4, 3, 2, 6, 8], 8)
    assert sorted(i for b in bins for i in b) == list(range(6)) and all(sum([5, 4, 3, 2, 6, 8][i] for i in b) <= 8 for b in bins)
    assert len(bins) == 4
    assert best_fit([], 8) == []


@pytest.mark.parametrize("group_items", [10, 100_000])
def test_containers_hold_every_byte_once(spark, group_items):
    rng = random.Random(group_items)
    docs = [(n, "é" * rng.randrange(1, 40) if n % 3 else "x" * rng.choice([1, 99, 100, 101, 250])) for n in range(300)] + [(900, None), (901, ""), (902, "日本" * 200), (5, "again")]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "id bigint, t string, size string").repartition(5)
    rows = pack(df, "id", "t", 100, group_items=group_items).collect()
    held = defaultdict(int)
    parts = defaultdict(list)
    for r in rows:
        if r.container is not None:
            assert r.at == held[r.container] or r.at >= 0
            held[r.container] += r.n_tokens
            parts[r.id].append((r.piece, r.start_token, r.n_tokens))
    assert max(held.values()) <= 100
    want = defaultdict(int)
    for i, t in docs:
        want[i] += len((t or "").encode())
    assert {i: sum(p[2] for p in ps) for i, ps in parts.items()} == {i: n for i, n in want.items() if n}
    text = "日本" * 200
    for _, s, n in parts[902]:
        text.encode()[s : s + n].decode()  # no character is cut
    once = {i for i, t in docs if t and len(t.encode()) <= 100}
    assert all(len(parts[i]) == (2 if i == 5 else 1) for i in once)
    assert {r.id for r in rows if r.container is None} == {900, 901}
    assert len(held) <= math.ceil(sum(want.values()) / 100) * 1.06 + 1
    by = defaultdict(list)
    for r in rows:
        if r.container:
            by[r.container].append((r.at, r.n_tokens))
    assert all(a + n == b for rs in by.values() for (a, n), (b, _) in zip(sorted(rs), sorted(rs)[1:]))


@pytest.mark.parametrize("name", ["over half", "three fifths", "a third", "any"])
def test_no_group_exceeds_its_bound_and_little_is_wasted(spark, name):
    rng = random.Random(name)
    size = {"over half": lambda: rng.randrange(511, 901), "three fifths": lambda: 600, "a third": lambda: 340, "any": lambda: rng.randrange(1, 1001)}[name]
    sizes = [size() for _ in range(6000)]
    df = spark.createDataFrame([(n, "x" * k) for n, k in enumerate(sizes)], "id bigint, t string")
    made = pack(df, "id", "t", 1000, group_items=1000).select("container").distinct().count()  # a larger group would raise
    assert made <= 1.02 * len(best_fit(sizes, 1000))


def test_rows_of_one_id_are_packed_in_many_groups(spark):
    df = spark.createDataFrame([(None if n % 2 else 7, "y" * 40) for n in range(500)], "id bigint, t string")
    rows = pack(df, "id", "t", 100, group_items=50).collect()
    assert Counter(r.id for r in rows) == {7: 250, None: 250} and len({r.container for r in rows}) == 250


def test_no_items(spark):
    assert pack(spark.createDataFrame([], "id bigint, t string"), "id", "t", 10).count() == 0


def test_containers_of_the_documents_waste_little(spark):
    rows = Q.p8_containers(spark, SF).where("container is not null").groupBy("container").sum("n_tokens").collect()
    fill = [r[1] for r in rows]
    assert max(fill) <= 8192 and sum(fill) / (8192 * len(fill)) > 0.95


# ------------------------------------------------------------------ mixtures


def test_quotas_are_exact():
    counts = np.array([1000, 10, 0, 333])
    q = split_quotas(counts, 13, 2)
    assert (q.sum(axis=0) == counts).all() and np.ptp(q.sum(axis=1)) <= 1 and (q >= 0).all()
    tree = SplitTree(counts, 13, 2)
    assert (np.array([np.bincount([tree.shard(k, b) for b in range(n)], minlength=13) for k, n in enumerate(counts)]).T == q).all()


@pytest.mark.parametrize("shards", [7, 4096])
def test_every_shard_holds_the_mixture(spark, shards):
    rng = random.Random(shards)
    docs = [(n, rng.choice(["a", "a", "a", "b", "c"]), "x" * rng.randrange(1, 4)) for n in range(300_000 if shards > 7 else 20_000)]
    df = spark.createDataFrame(docs, "id bigint, s string, t string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 1)], "source string, target_share double, max_repeats int")
    m = mix(df, "id", "t", "s", targets, shards=shards, min_blocks=4, line_docs=7000)
    goal = m.agg({"n_tokens": "sum"}).first()[0] / shards
    held = {(r.shard, r.source): r.n_tokens for r in shard_shares(m).collect()}
    assert len(held) == 3 * shards and {k for k, _ in held} == set(range(shards))
    # to a document at either end and a block of those left over
    for (_, source), n in held.items():
        share = {"a": 0.5, "b": 0.3, "c": 0.2}[source]
        assert abs(n - share * goal) <= max(0.1 * share * goal, 3) + 2 * 0.2 * goal / 4
    if shards == 7:
        places = defaultdict(list)
        for r in m.collect():
            places[r.shard].append(r.place)
        assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())


def test_more_targets_than_planned_for_are_an_error(spark):
    targets = spark.range(10_001).selectExpr("string(id) as source", "0.1 as target_share", "1 as max_repeats")
    with pytest.raises(ValueError):
        mix(spark.createDataFrame([(1, "x", "a")], "id bigint, t string, s string"), "id", "t", "s", targets)


def test_mixture_holds_its_shares(spark):
    docs = [(n, "x" * (20 + n % 30), " Big " if n % 2 else "BIG") for n in range(3000)] + [(10_000 + n, "y" * 25, "small") for n in range(60)] + [(20_000, "z", None), (20_001, None, "big"), (20_002, "", "big"), (20_003, "q", "other")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "id bigint, t string, s string, block int").repartition(4)
    targets = spark.createDataFrame([("big", 0.8, 1), ("Small", 0.15, 4), ("absent", 0.05, 9), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    m = mix(df, "id", "t", "s", targets, shards=5).persist()
    rows = m.collect()
    assert len({(r.id, r.copy) for r in rows}) == len(rows)
    assert max(Counter(r.id for r in rows if r.source == "small").values()) == 4 and max(Counter(r.id for r in rows if r.source == "big").values()) == 1
    shares = {r.source: r for r in reached_shares(m, targets).collect()}
    assert abs(shares["big"].actual_share - 0.8 / 0.95) < 0.002 and shares["absent"].n_docs == 0 and shares["small"].most_copies == 4
    assert shares["small"].n_tokens == 4 * 60 * 25
    for s in range(5):
        assert sorted(r.place for r in rows if r.shard == s) == list(range(1, sum(r.shard == s for r in rows) + 1))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix(df.repartition(2), "id", "t", "s", targets, shards=5).collect()))
    half = mix(df, "id", "t", "s", targets, total_tokens=3000)
    assert abs(sum(r.n_tokens for r in half.collect()) - 3000) < 120
    assert mix(df.where("false"), "id", "t", "s", targets).count() == 0
    assert mix(df, "id", "t", "s", targets.where("false")).count() == 0


def test_shares_reached_on_the_documents(spark):
    rows = Q.p9_shares(spark, SF).collect()
    there = sum(r.target_share for r in rows if r.n_docs)
    largest = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("max(octet_length(text))").first()[0]
    total = sum(r.n_tokens for r in rows)
    for r in rows:
        assert r.most_copies <= r.max_repeats
        assert not r.n_docs or abs(r.n_tokens - r.target_share / there * total) <= 2 * largest


def test_rows_without_id_and_equal_rows_are_mixed_too(spark):
    df = spark.createDataFrame([(None, "xx", "a")] * 40 + [(1, "xx", "a")] * 40 + [(2, "yyy", "b")], "id bigint, t string, s string")
    targets = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 6)], "source string, target_share double, max_repeats int")
    rows = mix(df, "id", "t", "s", targets, shards=2).collect()
    assert Counter((r.id, r.source) for r in rows) == {(None, "a"): 40, (1, "a"): 40, (2, "b"): 6} and {r.shard for r in rows} == {0, 1}


# ------------------------------------------------------------------ pieces


def check_pieces(data, pieces, limit, overlap):
    assert pieces[0][0] == 0 and pieces[-1][2] == len(data)
    for (s0, a0, e0), (s, a, e) in zip(pieces, pieces[1:]):
        assert a == e0 and e > a and e - s <= limit
        assert min(overlap, e0) <= a - s <= overlap + 3
    for s, a, e in pieces:
        assert e - s <= limit
        data[s:e].decode()


@pytest.mark.parametrize("seed", range(4))
def test_pieces_are_whole_and_within_the_limit(seed):
    rng = random.Random(seed)
    bits = ["word ", "Sentence end. ", "\n", "\r\n\r\n", "日本語。", "é", "x" * 300, "😀" * 50, ", "]
    data = "".join(rng.choice(bits) for _ in range(2000)).encode()
    check_pieces(data, cut_points(data, 512, 40), 512, 40)
    solid = ("😀" * 3000).encode()
    check_pieces(solid, cut_points(solid, 512, 40), 512, 40)
    assert cut_points(b"short", 512, 40) == [(0, 0, 5)]


def test_pieces_end_at_natural_boundaries():
    rng = random.Random(1)
    data = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 9))) + rng.choice(["", "", ".", ".\n\n"]) for _ in range(5000)).encode()
    for _, _, e in cut_points(data, 1024, 64)[:-1]:
        assert data[e - 1 : e] in (b" ", b"\n")


@pytest.mark.parametrize(("limit", "overlap"), [(1024, 64), (4096, 256), (65_536, 1024)])
def test_an_edit_changes_only_neighbouring_pieces(limit, overlap):
    rng = random.Random(limit)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    words = [word() + rng.choice(["", "", "", "", ",", ".", ".\n", ".\n\n"]) for _ in range(limit * 4)]
    one = " ".join(words).encode()
    cuts = cut_points(one, limit, overlap)
    assert sum(e - s for s, _, e in cuts[:-1]) >= 0.68 * limit * len(cuts[:-1])
    cores = lambda d: {d[a:e] for _, a, e in cut_points(d, limit, overlap)}
    was, changed = cores(one), []
    for size in (14, 200, 1000, 5000) * (60 if limit < 5000 else 6):
        at = rng.randrange(len(one))
        extra = " ".join(word() for _ in range(size // 5)).encode()[:size]
        changed.append(len(was - cores(one[:at] + extra + one[at:])))
    assert sum(changed) / len(changed) <= 2.3


def test_strength_depends_on_its_window_only():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, 20_000).astype(np.uint8)
    assert (strengths(x)[500:] == strengths(x[500:])).all() and len(strengths(x)) == 20_000 - WINDOW + 1
    assert len(strengths(x[:10])) == 0


def test_a_short_piece_ends_at_the_last_boundary_before_a_long_stretch():
    data = b"Head\n\nmore words here " + b"x" * 2000
    s, a, e = cut_points(data, 512, 40)[0]
    assert data[:e] == b"Head\n\nmore words here "


def test_split_oversized(spark):
    texts = [(1, "a b. " * 400), (2, "short"), (3, None), (4, ""), (5, "é" * 600), (1, "a b. " * 400)]
    df = spark.createDataFrame([(*t, 0) for t in texts], "id bigint, t string, piece int")
    rows = split_oversized(df, "id", "t", 500, 32).collect()
    assert {r.id for r in rows} == {1, 5}
    for r in rows:
        assert len(r.text.encode()) == r.n_tokens <= 500 and r.end_token - r.start_token == r.n_tokens
    five = sorted((r for r in rows if r.id == 5), key=lambda r: r.piece)
    assert "".join(r.text.encode()[r.overlap_tokens :].decode() for r in five) == "é" * 600
    assert Counter(r.piece for r in rows if r.id == 1)[1] == 2
    assert split_oversized(df.where("false"), "id", "t", 500, 32).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "id", "t", 100, 99)
