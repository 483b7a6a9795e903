"""Hand-derived answers of the counting, trip, weather, ranking, text-weight, file and streaming operators."""

import datetime as dt
import math

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from quillspan.functions.tokens import is_hashtag, is_strict, is_word, lines, space_tokens
from quillspan.operators import lsa as L
from quillspan.operators import stats as S
from quillspan.operators import text as X
from quillspan.operators import trips as T
from quillspan.operators.weather import parse_records, split_years
from quillspan.sources import readers, sinks


def texts(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "text string")


@pytest.mark.parametrize(
    ("line", "tokens"),
    [("a b a", ["a", "b", "a"]), ("a  b", ["a", "", "b"]), ("a b  ", ["a", "b"]), ("  ", []), ("", [""]), (" a", ["", "a"]), ("1 .5 1.2.3 -x a-b", ["1", ".5", "1.2.3", "-x", "a-b"])],
)
def test_space_tokens(spark, line, tokens):
    assert texts(spark, line).select(space_tokens(F.col("text"))).first()[0] == tokens


def test_predicates(spark):
    d = spark.createDataFrame([(t,) for t in ("a", "1", ".5", "1.2.3", "-x", "a-b", "", "A", "a\n", "#a1", "#", "#a_b", "#Ä")], "t string")
    keep = lambda p: [r.t for r in d.where(p(F.col("t"))).collect()]
    assert keep(is_strict) == ["a", "1", ".5", "a-b", ""]
    assert keep(is_word) == ["a", "-x", "a-b", ""]
    assert keep(is_hashtag) == ["#a1", "#"]


def test_pairs_and_stripes(spark):
    d = texts(spark, "a b a", None)
    pairs = lambda m, *t: {(r.pair, r.cnt) for r in X.word_pairs(texts(spark, *t), "text", m).collect()}
    assert pairs(1, "a b a") == {("a:b", 1), ("b:a", 1)}
    assert pairs(2, "a b a") == {("a:b", 1), ("b:a", 1), ("a:a", 1)}
    assert pairs(1, "a X b") == set() and pairs(2, "a X b") == {("a:b", 1)}
    assert pairs(1, "1 .5 1.2.3 -x a-b") == {("1:.5", 1)} and pairs(3, "") == set()
    assert {(r.token, r.neighbour, r.cnt) for r in X.word_stripes(d, "text", 1).collect()} == {("a", "b", 2), ("b", "a", 2)}
    assert {(r.token, r.neighbour) for r in X.word_stripes(texts(spark, "a  b"), "text", 1).collect()} == {("a", ""), ("b", "")}
    assert {r.token: r.stripe for r in X.as_stripes(X.word_stripes(d, "text", 1)).collect()} == {"a": {"b": 2}, "b": {"a": 2}}
    assert lines(texts(spark, "a\r\nb\nc"), "text").count() == 3


def test_hashtag_pairs(spark):
    t = X.hashtags_of(texts(spark, "#a #b #a x", "#b #a #c", None, "no"), "text")
    assert {(r.token, r.cnt) for r in X.hashtag_counts(t).collect()} == {("#a", 3), ("#b", 2), ("#c", 1)}
    assert {(r.pair, r.cnt) for r in X.hashtag_pairs(t).collect()} == {("#a:#a", 1), ("#a:#b", 2), ("#a:#c", 1), ("#b:#c", 1)}


def test_trip_hours_cut_toward_zero(spark):
    at = lambda s: dt.datetime.fromisoformat(f"2024-01-01 {s}")
    rows = [(at("10:00"), at(e)) for e in ("10:50", "13:00", "12:59", "09:30", "08:30")]
    d = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in d.select(T.whole_units("a", "b", T.HOUR_US)).collect()] == [0, 3, 2, 0, -1]
    assert spark.range(1).select(T.great_circle_km(F.lit(10.0), F.lit(20.0), F.lit(40.0), F.lit(20.0))).first()[0] == 3130
    assert spark.range(1).select(T.great_circle_km(F.lit(20.0), F.lit(10.0), F.lit(20.0), F.lit(40.0))).first()[0] == 3335


def test_iso_weekday(spark):
    d = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 7),)], "t timestamp_ntz")
    assert [r[0] for r in d.select(T.iso_weekday("t")).collect()] == [1, 7]


def test_weather_record(spark):
    def record(temp):
        s = ["x"] * 100
        for a, v in ((15, "1990"), (19, "12"), (21, "31"), (23, "07"), (28, "+44500"), (34, "-031250"), (46, "+0099"), (60, "270"), (65, "0035"), (70, "00450"), (78, "009999"), (87, temp), (93, "-0005")):
            s[a : a + len(v)] = v
        return "".join(s)

    got = parse_records(texts(spark, record("-0012"), record("+9999"), record("+0012")), "text").orderBy("label").collect()
    assert [r.label for r in got] == [-1.2, 1.2]
    assert (got[0].year, got[0].latitude, got[0].longitude, got[0].speed, got[0].dew_point) == (1990, 44.5, -31.25, 3.5, -0.5)
    a, b = split_years(parse_records(texts(spark, record("+0001")), "text"))
    assert (a.count(), b.count()) == (1, 0)


def test_ranks_and_threshold_metrics(spark):
    d = spark.createDataFrame([(x,) for x in (5.0, 1.0, 1.0, 3.0, None)], "x double")
    assert {r.value: r.rank for r in S.average_ranks(d, "x").collect()} == {1.0: 1.5, 3.0: 3.0, 5.0: 4.0}
    scored = spark.createDataFrame([(1.0, 1), (1.0, 0), (0.0, 1), (0.0, 0), (None, 1)], "s double, l int")
    m = S.threshold_metrics(scored, "s", "l")
    assert {r.threshold: (r.precision, r.recall) for r in m.collect()} == {1.0: (0.5, 0.5), 0.0: (0.5, 1.0)}
    assert S.ranking_metrics(scored, "s", "l").first().auroc == 0.5
    assert S.threshold_metrics(scored.where("false"), "s", "l").count() == 0 and S.average_ranks(d.where("false"), "x").count() == 0
    many = spark.range(3000).selectExpr("id * 37 % 3001 * 1.0 as s", "int(id % 3 = 0) as l")
    rows = sorted(many.collect(), key=lambda r: -r.s)
    ours = {r.threshold: (r.tp, r.fp) for r in S.threshold_metrics(many, "s", "l").collect()}
    tp = 0
    for k, r in enumerate(rows):
        tp += r.l
        assert ours[r.s] == (tp, k + 1 - tp)


def test_tf_idf_and_decomposition(spark):
    docs = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a", "c"])], "d int, terms array<string>")
    tf = L.term_freqs(docs, "d", "terms")
    w = {(r.d, r.term): r.weight for r in L.tf_idf(tf, L.doc_freqs(tf, 2), "d").collect()}
    assert w[(1, "a")] == 0 and math.isclose(w[(1, "b")], math.log(2) / 3) and math.isclose(w[(2, "c")], math.log(2) / 2)
    rng = np.random.default_rng(0)
    many = spark.createDataFrame([(i, [f"w{j}" for j in rng.integers(0, 12, 9)]) for i in range(40)], "d int, terms array<string>")
    tf = L.term_freqs(many, "d", "terms")
    idf = L.doc_freqs(tf, 40)
    weights = L.tf_idf(tf, idf, "d")
    m = L.Lsa(weights, idf, "d", 5)
    dense = np.zeros((40, len(m.terms)))
    for r in weights.collect():
        dense[r.d, m.terms.index(r.term)] = r.weight
    assert np.allclose(m.s, np.linalg.svd(dense)[1][:5])
    u = np.array([r.u for r in m.doc_weights().collect()])
    assert np.allclose(u.T @ u, np.eye(5), atol=1e-6)
    assert m.top_terms(3).count() == 15 and m.top_docs(2).count() == 10
    q = np.zeros(len(m.terms))
    q[m.terms.index("w3")] = {r.term: r.idf for r in idf.collect()}["w3"]
    best = m.query(["w3", "unknown"], idf, 1).first()
    assert math.isclose(best.score, float((dense @ m.v @ (m.v.T @ q)).max()), rel_tol=1e-6)
    assert m.query(["w3"], idf, 3, cosine=True).count() == 3


def test_sinks_and_readers(spark, tmp_path):
    counts = spark.createDataFrame([("a", 2, "word"), ("1", 1, "number")], "token string, cnt bigint, kind string")
    sinks.write_by_kind(counts, f"{tmp_path}/k")
    assert {p.name for p in (tmp_path / "k").iterdir() if p.is_dir()} == {"kind=word", "kind=number"}
    sinks.write_tsv(counts.drop("kind"), f"{tmp_path}/t")
    assert {tuple(r) for r in readers.read_tsv_counts(spark, f"{tmp_path}/t").collect()} == {("a", 2), ("1", 1)}
    sinks.write_stripes(X.as_stripes(X.word_stripes(texts(spark, "a b"), "text", 1)), f"{tmp_path}/s")
    assert {r.value for r in readers.read_lines(spark, f"{tmp_path}/s").collect()} == {'a\t{"b":1}', 'b\t{"a":1}'}
    movies = spark.createDataFrame([(1999, 'A "b"', "o", "d", "c", "g", "w", "two\nlines, and more")], readers.MOVIE_SCHEMA)
    sinks.write_csv(movies, f"{tmp_path}/m", single_file=True)
    assert readers.read_csv_records(spark, f"{tmp_path}/m", readers.MOVIE_SCHEMA).collect() == movies.collect()
    (tmp_path / "bad.csv").write_text("h\n1999,t,o,d,c,g,w,p\nx,t,o,d,c,g,w,p\n")
    bad = readers.read_csv_records(spark, f"{tmp_path}/bad.csv", readers.MOVIE_SCHEMA)
    assert bad.count() == len(bad.select("title").collect()) == 1
    sinks.write_csv(spark.createDataFrame([(1, ["x", "y"])], "i int, a array<string>"), f"{tmp_path}/arr")
    assert readers.read_csv_inferred(spark, f"{tmp_path}/arr").first().a == "x y"
    (tmp_path / "stop").write_text("the\n and \n\n")
    assert {r.token for r in readers.read_stop_words(spark, f"{tmp_path}/stop").collect()} == {"the", "and"}
    assert X.without(texts(spark, "the", "cat").withColumnRenamed("text", "token"), readers.read_stop_words(spark, f"{tmp_path}/stop")).count() == 1
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"boroughCode":3,"borough":"B"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}]}')
    g = readers.read_geojson(spark, f"{tmp_path}/g.json").first()
    assert (g.boroughcode, g.borough) == (3, "B") and "Polygon" in g.geojson
    assert readers.sample_rows(spark.range(10_000), 0.1, key="id").count() == readers.sample_rows(spark.range(10_000), 0.1, key="id").count()
    assert 800 < readers.sample_rows(spark.range(10_000), 0.1).count() < 1200


def test_more_readers_sinks_and_columns(spark, tmp_path, capsys):
    from quillspan.functions.tokens import annotated, joined, parted, quoted, separated

    for d in ("AA/x", "AB", "AC"):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "f.txt").write_text(f"in {d}\n")
    assert {r.value for r in readers.read_lines(spark, f"{tmp_path}/{{AB,AC}}").collect()} == {"in AB", "in AC"}
    assert readers.read_lines(spark, str(tmp_path), recursive=True).count() == 3
    (tmp_path / "t").write_text("the\t 12\n\n  of   7 more\nalone\n")
    assert [tuple(r) for r in readers.read_whitespace_table(spark, f"{tmp_path}/t", ["w", "n"]).collect()] == [("the", "12"), ("of", "7"), ("alone", None)]
    counts = spark.createDataFrame([("b", 2), ("7", 9), ("a", 2), ("?", 1)], "token string, cnt bigint")
    sinks.write_words_and_numbers(counts, f"{tmp_path}/w")
    files = [p for p in (tmp_path / "w" / "words").iterdir() if p.suffix == ".csv"]
    assert len(files) == 1 and sorted(files[0].read_text().split()) == ["2", "2", "a", "b"]
    assert readers.read_tsv_counts(spark, f"{tmp_path}/w/numbers").first().cnt == 9
    sinks.write_sorted_counts(counts, f"{tmp_path}/s")
    assert "".join(p.read_text() for p in sorted((tmp_path / "s").glob("*.csv"))).split() == ["token,cnt", "7,9", "a,2", "b,2", "?,1"]
    assert sinks.show_rows(counts.orderBy("token"), 2) == ["7\t9", "?\t1"] and "7\t9" in capsys.readouterr().out
    d = spark.createDataFrame([("a:b:c", ["x", "y"]), (None, []), ("q", None)], "k string, a array<string>")
    assert [r[0] for r in d.select(quoted(F.col("k"))).collect()] == ['"a:b:c"', '"null"', '"q"']
    assert [r[0] for r in d.select(parted(joined(F.col("a")))).collect()] == [["x", "y"], [], None]
    assert [tuple(r)[:2] for r in separated(d, "k", ["l", "r"]).collect()] == [("a", "b:c"), (None, None), ("q", None)]
    made = spark.sparkContext.accumulator(0)

    def model():
        made.add(1)
        return lambda text: text.split(":")

    assert [r.terms for r in annotated(d.coalesce(1), "k", model).collect()] == [["a", "b", "c"], [], ["q"]] and made.value == 1
    m = spark.createDataFrame([("a", 2.0), ("a", None), ("b", None)], "k string, v double").groupBy("k").agg(T.mean_or_zero(F.col("v")).alias("m"))
    assert {r.k: r.m for r in m.collect()} == {"a": 2.0, "b": 0.0}


def test_command_line(spark, tmp_path, capsys):
    from quillspan.__main__ import main

    (tmp_path / "in" / "x").mkdir(parents=True)
    (tmp_path / "in" / "x" / "f").write_text("a b a\nthe b\n")
    (tmp_path / "stop").write_text("the\n")
    main(["word-count", f"{tmp_path}/in", f"{tmp_path}/c", "--top", "5", "--stop-words", f"{tmp_path}/stop"])
    assert {tuple(r) for r in readers.read_tsv_counts(spark, f"{tmp_path}/c").collect()} == {("a", 2), ("b", 2)}
    main(["word-pairs", f"{tmp_path}/in", f"{tmp_path}/p", "-m", "2"])
    assert ("a:a", 1) in {tuple(r) for r in readers.read_tsv_counts(spark, f"{tmp_path}/p").collect()}
    main(["word-stripes", f"{tmp_path}/in", f"{tmp_path}/s"])
    assert any(r.value.startswith('the\t{"b":1') for r in readers.read_lines(spark, f"{tmp_path}/s").collect())
    main(["query", "trip_hours_hist", SF, f"{tmp_path}/q"])
    assert spark.read.parquet(f"{tmp_path}/q").count() > 0 and "0 min" in capsys.readouterr().out
    for bad in (["word-pairs", "x"], ["query", "none", SF, "y"]):
        with pytest.raises(SystemExit):
            main(bad)


def test_processing_time_batches_until_the_timeout(spark, tmp_path):
    from quillspan.streaming.hashtags import on_batches

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("x\ny\n")
    seen = []
    on_batches(spark.readStream.text(f"{tmp_path}/in"), lambda batch, n: seen.append(batch.count()), f"{tmp_path}/cp", every="1 second", timeout_s=12)
    assert seen == [2]


def test_windows_of_a_stream_with_late_rows(spark, tmp_path):
    import os

    from quillspan.streaming.hashtags import merged_windows, window_counts

    (tmp_path / "in").mkdir()
    files = ["2024-01-10 10:05:00,a\n2024-01-10 10:50:00,a", "2024-01-10 10:20:00,a\n2024-01-12 00:00:00,b", "2024-01-12 00:05:00,b", "2024-01-10 10:30:00,a\n2024-01-12 00:10:00,b"]
    for n, text in enumerate(files):
        (tmp_path / "in" / f"f{n}").write_text(text)
        os.utime(tmp_path / "in" / f"f{n}", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema("ts timestamp, kind string").option("maxFilesPerTrigger", 1).csv(f"{tmp_path}/in")
    got = merged_windows(window_counts(stream, "ts", "kind", late="1 day"), f"{tmp_path}/out", ["window_start", "kind"])
    # the second file's row of the tenth is within a day, the last one's comes after the watermark has passed (late rows meet the watermark a batch later)
    assert {(r.window_start, r.kind, r.cnt) for r in got.collect()} == {(dt.datetime(2024, 1, 10, 10), "a", 3), (dt.datetime(2024, 1, 12, 0), "b", 3)}


def test_a_cluster_needs_a_shared_checkpoint_folder(monkeypatch):
    from quillspan.runtime import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


def test_stream_writes_a_folder_per_batch(spark, tmp_path):
    from quillspan.streaming.hashtags import hashtag_batches

    (tmp_path / "in").mkdir()
    texts(spark, "#a #b", "#a").write.parquet(f"{tmp_path}/in/x")
    stream = spark.readStream.schema("text string").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    hashtag_batches(stream, "text", f"{tmp_path}/out")
    assert {(r.token, r.cnt) for r in spark.read.parquet(f"{tmp_path}/out/hashtags_0").collect()} == {("#a", 2), ("#b", 1)}
    assert spark.read.parquet(f"{tmp_path}/out/hashtag_pairs_0").first().pair == "#a:#b"
    assert spark.read.parquet(f"{tmp_path}/out/tweets_0").count() == 2


def test_tree_models_and_concepts_run(spark):
    from quillspan.plans.analysis_queries import QUERIES, SLOW

    r = SLOW["dt_classifier_cv"](spark, SF).first()
    assert 0 <= r.accuracy <= 1 and 0 <= r.area_under_roc <= 1
    assert QUERIES["lsa_query"](spark, SF).count() == 10


def test_model_queries_search_the_whole_grids(spark, monkeypatch):
    from quillspan.operators import ml
    from quillspan.plans.analysis_queries import SLOW

    class Seen(Exception):
        pass

    dims = []
    hasher = ml.FeatureHasher

    def seen(estimator, grid, evaluator, data, folds=5, seed=11, parallelism=8):
        raise Seen(grid, folds)

    monkeypatch.setattr(ml, "cross_validate", seen)
    monkeypatch.setattr(ml, "FeatureHasher", lambda **how: dims.append(how["numFeatures"]) or hasher(**how))
    tree = {"impurity": ["gini", "entropy"], "maxBins": [50, 100, 300], "maxDepth": [10, 20, 30]}
    for name, grid in (("dt_classifier_cv", tree), ("rf_classifier_cv", {"numTrees": [5, 10, 20], **tree}), ("rf_regressor_cv", {"maxBins": [100, 200], "maxDepth": [5, 10]})):
        with pytest.raises(Seen) as e:
            SLOW[name](spark, SF)
        assert e.value.args == (grid, 5)
    assert dims == [32768, 32768]


def test_unused_hashed_columns_change_no_tree_and_models_are_read_again(spark, tmp_path):
    from pyspark.ml.classification import DecisionTreeClassifier

    from quillspan.operators import ml

    d = spark.createDataFrame([("abc"[n % 3], float(n % 7), "Yes" if n % 3 == 1 or n % 7 > 4 else "No") for n in range(200)], "k string, x double, y string")
    prepare = ml.hashed_features(d, ["k", "x"], "y", 1024)
    h = prepare.transform(d)
    assert h.first().features.size == 4
    a, b = (DecisionTreeClassifier(featuresCol=c, labelCol="indexed_label").fit(h) for c in ("features", "hashed"))
    assert a.numNodes == b.numNodes and [r.prediction for r in a.transform(h).collect()] == [r.prediction for r in b.transform(h).collect()]
    model, p, accuracy, _ = ml.classify(d, ["k", "x"], "y", grid={"maxDepth": [5]}, folds=2, dim=1024)
    assert accuracy > 0.9
    for _ in range(2):
        ml.save_model(model, f"{tmp_path}/m")
    again = ml.load_model(f"{tmp_path}/m")
    assert [r.prediction for r in again.transform(d).collect()] == [r.prediction for r in model.transform(d).collect()]


def test_regression_refuses_null_features(spark):
    from quillspan.operators.ml import regress

    rows = spark.createDataFrame([(float(i), float(i % 7)) for i in range(40)], "x double, label double")
    with pytest.raises(Exception, match="(?i)null"):
        regress(rows, spark.createDataFrame([(None, 1.0), (2.0, 2.0)], "x double, label double"), ["x"], "label", {"numTrees": [2]}, folds=2)


def repeated_rows(spark, seed=0, n=1500):
    """Rows with many repeats: (k, x, z, label), labels following the features only in part."""
    g = np.random.default_rng(seed)
    k, x, z = g.integers(0, 3, n), g.integers(0, 12, n), g.integers(0, 4, n)
    y = (g.random(n) < 0.15 + 0.5 * ((x > 5) ^ (k == 1)) + 0.05 * z).astype(int)
    return spark.createDataFrame([("abc"[a], float(b), float(c), "Yes" if d else "No") for a, b, c, d in zip(k, x, z, y)], "k string, x double, z double, y string")


@pytest.mark.parametrize("most", [4, 32])
@pytest.mark.parametrize("impurity", ["gini", "entropy"])
def test_one_grown_tree_is_the_models_tree_at_every_depth(spark, impurity, most):
    from pyspark.ml.classification import DecisionTreeClassifier

    from quillspan.operators import ml, treegrid

    d = repeated_rows(spark)
    h = ml.hashed_features(d, ["k", "x", "z"], "y", 1024).transform(d).select("features", "indexed_label").coalesce(1).cache()
    rows = h.collect()
    x, y = np.array([r.features.toArray() for r in rows]), np.array([int(r.indexed_label) for r in rows])
    cells, at = np.unique(np.column_stack([x, y]), axis=0, return_inverse=True)
    w = np.bincount(at.ravel()).astype(float)
    cuts = treegrid.splits_of(cells[:, :-1], w, most)
    binned, bins = treegrid.binned(cells[:, :-1], cuts)
    tree = treegrid.Tree(binned, bins, cells[:, -1].astype(int), w, impurity, [2, 4, 30], x.shape[1], np.random.default_rng(0))
    for depth in (2, 4, 30):
        m = DecisionTreeClassifier(labelCol="indexed_label", impurity=impurity, maxBins=most, maxDepth=depth).fit(h)
        assert np.array_equal(tree.leaf_stats(depth)[at.ravel()], np.array([r.rawPrediction.toArray() for r in m.transform(h).collect()]))
        saved = tree.nodes(depth, cuts)
        assert len(saved["id"]) == m.numNodes
        for row, leaf in zip(cells[:, :-1], tree.leaf_stats(depth)):
            i = 0
            while saved["leftChild"][i] >= 0:
                i = saved["leftChild"][i] if row[saved["featureIndex"][i]] <= saved["threshold"][i][0] else saved["rightChild"][i]
            assert saved["impurityStats"][i] == list(leaf)


def test_a_search_of_trees_has_the_means_of_cross_validation_by_rows_and_fits_once(spark, monkeypatch):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    from quillspan.operators import ml, treegrid

    d = repeated_rows(spark)
    prepare = ml.hashed_features(d, ["k", "x", "z"], "y", 1024)
    h = prepare.transform(d).groupBy("features", "indexed_label").count().withColumnRenamed("count", ml.REPEATS)
    e = DecisionTreeClassifier(labelCol="indexed_label", weightCol=ml.REPEATS)
    found = ml.cross_validate(e, {"impurity": ["gini", "entropy"], "maxBins": [8, 50, 100], "maxDepth": [2, 5, 20]}, BinaryClassificationEvaluator(labelCol="indexed_label"), h, 3, 7)
    # the same folds, row by row
    rows = h.collect()
    keys = np.array([(*r.features.toArray(), r.indexed_label) for r in rows])
    order = np.lexsort([keys[:, -1], *keys[:, :-1].T])
    dealt = treegrid.fold_weights(np.array([rows[i][ml.REPEATS] for i in order]), 3, 7)
    each = [(rows[i].features, rows[i].indexed_label, f) for i, counts in zip(order, dealt) for f, c in enumerate(counts) for _ in range(c)]
    single = spark.createDataFrame(each, ["features", "indexed_label", "fold"]).withColumn("fold", F.col("fold").cast("int"))
    e = DecisionTreeClassifier(labelCol="indexed_label")
    g = ParamGridBuilder().addGrid(e.impurity, ["gini", "entropy"]).addGrid(e.maxBins, [8, 50, 100]).addGrid(e.maxDepth, [2, 5, 20]).build()
    want = CrossValidator(estimator=e, estimatorParamMaps=g, evaluator=BinaryClassificationEvaluator(labelCol="indexed_label"), numFolds=3, foldCol="fold", parallelism=4).fit(single)
    assert found.avgMetrics == pytest.approx(want.avgMetrics, abs=1e-9)
    # by rows, the whole grid and five folds fit 91 models
    fits, fit = [], DecisionTreeClassifier._fit
    monkeypatch.setattr(DecisionTreeClassifier, "_fit", lambda self, data: fits.append(1) or fit(self, data))
    _, p, accuracy, area = ml.classify(d, ["k", "x", "z"], "y")
    assert len(fits) == 1 and accuracy > 0.6 and area > 0.5
    assert p.count() == d.randomSplit([0.9, 0.1], 11)[1].count()


def test_a_forest_grid_grows_the_best_forest_once(spark, tmp_path, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    from quillspan.operators import ml

    # by rows, this grid and its folds fit 25 forests
    fits, fit = [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, data: fits.append(self.getMaxDepth()) or fit(self, data))
    d = repeated_rows(spark, n=4000)
    grid = {"numTrees": [3, 7], "impurity": ["gini"], "maxBins": [16, 32], "maxDepth": [3, 6]}
    model, p, accuracy, area = ml.classify(d, ["k", "x", "z"], "y", "forest", grid, folds=3, dim=1024)
    forest = model.stages[-1]
    assert fits == [0]  # an empty model, for the nodes
    assert forest.getNumTrees in (3, 7) and forest.getMaxDepth() in (3, 6) and forest.numFeatures == 5 and forest.numClasses == 2
    assert all(1 < t.depth <= forest.getMaxDepth() for t in forest.trees)
    assert accuracy > 0.6 and area > 0.65
    ml.save_model(model, f"{tmp_path}/m")
    again = ml.load_model(f"{tmp_path}/m")
    assert [r.rawPrediction for r in again.transform(d).collect()] == [r.rawPrediction for r in model.transform(d).collect()]
    # every tree has its own bag of about as many rows as there are, and the forest's votes are its trees' shares
    sizes = [sum(t._call_java("rootNode").impurityStats().stats()) for t in forest.trees]
    n = d.randomSplit([0.9, 0.1], 11)[0].count()
    assert len(set(sizes)) > 1 and all(abs(s - n) < 6 * n**0.5 for s in sizes)
    h = ml.PipelineModel(model.stages[:-1]).transform(d).limit(50)
    by_tree = [[v.toArray() / sum(v.toArray()) for v in (r.rawPrediction for r in t.transform(h).collect())] for t in forest.trees]
    assert np.allclose(np.sum(by_tree, axis=0), [r.rawPrediction.toArray() for r in forest.transform(h).collect()])


def test_prefixes_of_bagged_trees_and_shared_splits_serve_the_whole_grid():
    from quillspan.operators import treegrid

    grid = {"impurity": ["gini", "entropy"], "maxBins": [50, 100, 300], "maxDepth": [10, 20, 30], "numTrees": [1, 5, 20]}
    serves = treegrid.shared(grid, 50, 12, True)
    assert len(serves) == 54 and set(serves.values()) == {(i, 50, m) for i in grid["impurity"] for m in (4, 12)}
    assert {v[1] for v in treegrid.shared(grid, 120, 12, True).values()} == {50, 100, 300}
    # a row of weight n is drawn like n rows: mean and variance n
    bag = np.random.default_rng(5).poisson(np.full(20_000, 40.0))
    assert abs(bag.mean() - 40) < 0.5 and abs(bag.var() - 40) < 3
    dealt = treegrid.fold_weights(np.full(20_000, 40.0), 5, 11)
    assert (dealt.sum(axis=1) == 40).all() and abs(dealt[:, 0].var() - 40 * 0.2 * 0.8) < 0.5


def test_filters_on_fields_do_not_compute_derived_lines_again(spark):
    from quillspan.plans.analysis_queries import fixed_width_lines

    raw = fixed_width_lines(spark, SF)
    once = raw._jdf.queryExecution().optimizedPlan().toString().count("lpad(")
    train, _ = split_years(parse_records(raw, "value", "l_orderkey"), 1993, 1996)
    assert train._jdf.queryExecution().optimizedPlan().toString().count("lpad(") == once
    assert parse_records(raw, "value", "value").columns[0] == "value"


def test_regression_forests_of_lower_depth_are_cut_from_the_deepest(spark, monkeypatch):
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    from quillspan.operators import ml

    g = np.random.default_rng(3)
    v = g.random((800, 3))
    rows = spark.createDataFrame([(*map(float, r), float(4 * r[0] + np.sin(9 * r[1]) + 0.1 * e)) for r, e in zip(v, g.normal(size=800))], "a double, b double, c double, y double")
    data = ml.cut(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows).select("features", "y").coalesce(1))
    e, ev = RandomForestRegressor(labelCol="y", numTrees=6, seed=5), RegressionEvaluator(labelCol="y", metricName="rmse")
    fits, fit = [], RandomForestRegressor._fit
    with monkeypatch.context() as m:
        m.setattr(RandomForestRegressor, "_fit", lambda self, d: fits.append(self.getMaxDepth()) or fit(self, d))
        found = ml.cross_validate(e, {"maxBins": [8, 32], "maxDepth": [2, 6]}, ev, data, 3, 7)
    assert fits == [6] * 7  # by combination: 12 and the best
    grid = ParamGridBuilder().addGrid(e.maxBins, [8, 32]).addGrid(e.maxDepth, [2, 6]).build()
    want = CrossValidator(estimator=e, estimatorParamMaps=grid, evaluator=ev, numFolds=3, seed=7).fit(data)
    assert found.avgMetrics == pytest.approx(want.avgMetrics, rel=1e-9)
    assert found.bestModel.toDebugString.split("\n", 1)[1] == want.bestModel.toDebugString.split("\n", 1)[1]
