"""Queries on weather records, term weights, latent concepts, tree models and file round trips, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import STOP_WORDS, letters_only
from ..operators import lsa as L
from ..operators import stats as S
from ..operators.weather import parse_records, split_years
from ..runtime import cut, spread, table
from ..sources.readers import MOVIE_SCHEMA, read_csv_records
from ..sources.sinks import write_csv
from ..streaming.hashtags import shared_path

WORDS = ["funeral", "captain", "treaty", "glacier"]
NUMBERS = ["quantity", "price", "discount", "tax"]


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "lineitem"))


def fixed_width_lines(spark: SparkSession, sf: str) -> DataFrame:
    """l_orderkey, l_linenumber, value: lineitem written as fixed-width weather records; every 37th temperature is missing."""
    pad = lambda c, n: F.lpad(c.cast("bigint").cast("string"), n, "0")
    sign = lambda c, n: F.concat(F.when(c < 0, "-").otherwise("+"), pad(F.abs(c), n - 1))
    c = F.col
    temp = F.when(F.pmod(c("l_orderkey"), F.lit(37)) == 0, F.lit("+9999")).otherwise(sign(F.round(c("l_quantity") * 10) - 150, 5))
    d = c("l_shipdate")
    parts = [
        pad(c("l_orderkey") % 1_000_000, 15), pad(F.year(d), 4), pad(F.month(d), 2), pad(F.dayofmonth(d), 2), pad(c("l_linenumber"), 2), F.lit("xxx"),
        sign(c("l_suppkey") % 90_000 - 45_000, 6), sign(c("l_partkey") % 180_000 - 90_000, 7), F.lit("xxxxx"), sign(c("l_suppkey") % 1000, 5), F.lit("xxxxxxxxx"),
        pad(c("l_partkey") % 360, 3), F.lit("xx"), pad(F.round(c("l_discount") * 100), 4), F.lit("x"), pad(F.least(F.floor(c("l_extendedprice")), F.lit(99_999)), 5), F.lit("xxx"),
        pad(c("l_orderkey") % 160_000, 6), F.lit("xxx"), temp, F.lit("x"), sign(F.round(c("l_tax") * 1000) - 40, 5),
    ]
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", F.concat(*parts).alias("value"))


def noaa_parse(spark: SparkSession, sf: str) -> DataFrame:
    return parse_records(fixed_width_lines(spark, sf), "value", "l_orderkey", "l_linenumber")


def year_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    inside, outside = split_years(noaa_parse(spark, sf), 1993, 1996)
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return one(inside, "train").unionByName(one(outside, "test"))


def _numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))


def pearson_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return S.pearson(_numbers(spark, sf), NUMBERS).select("a", "b", F.round("r", 9).alias("r"))


def spearman_rank(spark: SparkSession, sf: str) -> DataFrame:
    r = S.spearman(_numbers(spark, sf), "price", ["quantity", "discount", "tax"])
    return r.select("column", F.round("rho", 9).alias("rho"))


def strongest_correlate(spark: SparkSession, sf: str) -> DataFrame:
    r = spearman_rank(spark, sf).where("rho is not null and not isnan(rho)")
    return r.agg(F.max_by("column", F.struct(F.abs("rho"), "column")).alias("column"), F.max(F.abs("rho")).alias("strength"))


#: The columns of a weather record other than the air temperature.
WEATHER = ["year", "month", "day", "hour", "latitude", "longitude", "elevation", "direction", "speed", "ceiling", "distance", "dew_point"]


def spearman_weather(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlation of the air temperature with each of the twelve other columns."""
    r = S.spearman(noaa_parse(spark, sf), "label", WEATHER)
    return r.select("column", F.round("rho", 9).alias("rho"))


def _movies(spark: SparkSession, sf: str) -> DataFrame:
    """movie_id, terms: each movie with a plot once, its plot's words without stop-words."""
    m = spread(table(spark, sf, "movies").select("movie_id", "plot")).distinct().where("plot is not null")
    return m.select("movie_id", F.filter(letters_only(F.col("plot")), lambda t: ~t.isin(*STOP_WORDS)).alias("terms"))


def _weights(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = _movies(spark, sf)
    freqs = L.term_freqs(docs, "movie_id", "terms")
    idf = cut(L.doc_freqs(freqs, docs.count()))
    return freqs, idf, L.tf_idf(freqs, idf, "movie_id")


def tf(spark: SparkSession, sf: str) -> DataFrame:
    return L.term_freqs(_movies(spark, sf), "movie_id", "terms")


def doc_freq_top(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(spark, sf)[1]


def tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(spark, sf)[2]


def keyword_scores_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    _, idf, w = _weights(spark, sf)
    return L.keyword_scores(w, idf, "movie_id", WORDS).select("movie_id", F.round("score", 9).alias("score"))


def _lsa(spark: SparkSession, sf: str) -> tuple[L.Lsa, DataFrame]:
    _, idf, w = _weights(spark, sf)
    return L.Lsa(w, idf, "movie_id"), idf


def lsa_concept_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _lsa(spark, sf)[0].top_terms()


def lsa_concept_docs(spark: SparkSession, sf: str) -> DataFrame:
    """The concepts' top movies by title."""
    titles = table(spark, sf, "movies").groupBy("movie_id").agg(F.min("title").alias("label"))
    return _lsa(spark, sf)[0].top_docs().join(titles, "movie_id", "left")


def lsa_concept_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The concepts' top movies by genre."""
    genres = table(spark, sf, "movies").groupBy("movie_id").agg(F.min("genre").alias("label"))
    return _lsa(spark, sf)[0].top_docs().join(genres, "movie_id", "left")


def lsa_query(spark: SparkSession, sf: str) -> DataFrame:
    m, idf = _lsa(spark, sf)
    return m.query(WORDS, idf)


def lsa_query_cosine(spark: SparkSession, sf: str) -> DataFrame:
    m, idf = _lsa(spark, sf)
    return m.query(WORDS, idf, cosine=True)


def title_join(spark: SparkSession, sf: str) -> DataFrame:
    """title, n_terms, genre: each movie's number of plot terms beside the genre of every movie of the same title, k movies giving k x k rows."""
    m = table(spark, sf, "movies").select("movie_id", "title", "genre").distinct()
    terms = _movies(spark, sf).select("movie_id", F.size("terms").alias("n_terms"))
    return terms.join(m.select("movie_id", "title"), "movie_id").select("title", "n_terms").join(m.select("title", "genre"), "title")


def lsa_checks(spark: SparkSession, sf: str) -> DataFrame:
    """concept, term_norm, doc_norm, ordered, solves: what must hold of each concept whatever its sign: unit vectors, falling singular values, and A' u = s v."""
    m = _lsa(spark, sf)[0]
    v = m.term_weights()
    u = m.doc_weights().select("movie_id", F.posexplode("u").alias("concept", "u"))
    k = len(m.s)
    s = spark.createDataFrame([(c, float(m.s[c]), bool(c == 0 or m.s[c - 1] >= m.s[c])) for c in range(k)], "concept int, s double, ordered boolean")
    rows = m.rows.select("movie_id", F.explode("v").alias("x")).select("movie_id", "x.j", "x.weight")
    terms = spark.createDataFrame([(t, j) for j, t in enumerate(m.terms)], "term string, j int")
    wide = m.doc_weights().withColumnRenamed("u", "all_u")
    back = rows.join(wide, "movie_id").groupBy("j").agg(F.array(*[F.sum(F.col("weight") * F.col("all_u")[c]) for c in range(k)]).alias("a")).select("j", F.posexplode("a").alias("concept", "got"))
    off = back.join(F.broadcast(terms), "j").join(v, ["concept", "term"]).join(F.broadcast(s), "concept").groupBy("concept").agg(F.max(F.abs(F.col("got") - F.col("s") * F.col("weight"))).alias("off"))
    norms = v.groupBy("concept").agg(F.sum(F.col("weight") * F.col("weight")).alias("t")).join(u.groupBy("concept").agg(F.sum(F.col("u") * F.col("u")).alias("d")), "concept")
    return norms.join(s, "concept").join(off, "concept").select("concept", F.round("t", 6).alias("term_norm"), F.round("d", 6).alias("doc_norm"), "ordered", (F.col("off") < 1e-6).alias("solves"))


def hashed_survey(spark: SparkSession, sf: str) -> DataFrame:
    """outcome, indexed_label, n, total: labels by number, and what the hashed features hold in all: the numbers, and one for each category."""
    from pyspark.ml.functions import vector_to_array

    from ..operators.ml import hashed_features

    d = _survey(spark, sf)
    h = hashed_features(d, SURVEY_FEATURES, "outcome").transform(d)
    held = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return h.groupBy("outcome", "indexed_label").agg(F.count("*").alias("n"), F.round(F.sum(held), 4).alias("total"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """A continuous score: the order's price."""
    return table(spark, sf, "orders").select(F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))


def threshold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return S.threshold_metrics(_scored(spark, sf), "score", "label")


def ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    r = S.ranking_metrics(_scored(spark, sf), "score", "label")
    return r.select(F.round("auroc", 9).alias("auroc"), F.round("aupr", 9).alias("aupr"))


def _survey(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select(
        F.when(F.col("l_returnflag") == "R", "Yes").otherwise("No").alias("outcome"), F.year("l_shipdate").cast("string").alias("year"), "l_linestatus",
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    )


SURVEY_FEATURES = ["year", "l_linestatus", "quantity", "discount", "tax"]


def _classified(kind: str):
    """The operator's whole grid, five folds and full hash dimension."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        from ..operators.ml import classify

        _, p, accuracy, auc = classify(_survey(spark, sf), SURVEY_FEATURES, "outcome", kind)
        return p.groupBy("outcome", "prediction").agg(F.count("*").alias("n")).withColumn("accuracy", F.lit(accuracy)).withColumn("area_under_roc", F.lit(auc))

    return query


dt_classifier_cv = _classified("tree")
rf_classifier_cv = _classified("forest")


def rf_regressor_cv(spark: SparkSession, sf: str) -> DataFrame:
    """Per year of the test records, which are parsed and predicted in one pass."""
    from ..operators.ml import fit_regression

    train, test = split_years(noaa_parse(spark, sf), 1993, 1996)
    p = fit_regression(train, WEATHER, "label").transform(test)
    off = F.col("prediction") - F.col("label")
    years = cut(p.groupBy("year").agg(F.count("*").alias("n"), F.avg("prediction").alias("mean_prediction"), F.sum(off * off).alias("squares")))
    rmse = years.agg(F.sqrt(F.sum("squares") / F.sum("n"))).first()[0]
    return years.select("year", "n", "mean_prediction").withColumn("rmse", F.lit(rmse))


def movies_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Movies written as CSV with a header and read back with an explicit schema; line breaks and quotes survive, empty texts come back null."""
    path = shared_path(spark, "movies")
    m = table(spark, sf, "movies").drop("movie_id").distinct()
    write_csv(m, path)
    return read_csv_records(spark, path, MOVIE_SCHEMA).groupBy("release_year").agg(F.count("*").alias("n"), F.count("title").alias("titles"), F.sum(F.length("plot")).alias("plot_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        noaa_parse, year_split_counts, pearson_matrix, spearman_rank, spearman_weather, strongest_correlate, tf, doc_freq_top, tfidf, keyword_scores_tfidf, lsa_concept_terms, lsa_concept_docs,
        lsa_concept_labels, lsa_query, lsa_query_cosine, lsa_checks, title_join, threshold_metrics, ranking_metrics, hashed_survey, movies_csv_roundtrip,
    )
}
#: Queries that fit hundreds of models: they come after all others.
SLOW = {"rf_regressor_cv": rf_regressor_cv, "dt_classifier_cv": dt_classifier_cv, "rf_classifier_cv": rf_classifier_cv}

_NOAA = """
WITH n AS (SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, CAST(day(l_shipdate) AS INTEGER) AS day, CAST(l_linenumber AS INTEGER) AS hour,
(l_suppkey % 90000 - 45000) / 1000 AS latitude, (l_partkey % 180000 - 90000) / 1000 AS longitude, CAST(l_suppkey % 1000 AS INTEGER) AS elevation, CAST(l_partkey % 360 AS INTEGER) AS direction,
round(l_discount * 100) / 10 AS speed, CAST(least(floor(l_extendedprice), 99999) AS INTEGER) AS ceiling, CAST(l_orderkey % 160000 AS INTEGER) AS distance,
(round(l_tax * 1000) - 40) / 10 AS dew_point, (round(l_quantity * 10) - 150) / 10 AS label FROM lineitem WHERE l_orderkey % 37 <> 0)
"""
_WORDS_SQL = ", ".join(f"'{w}'" for w in WORDS)
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TFIDF = rf"""
WITH m AS (SELECT DISTINCT movie_id, plot FROM movies WHERE plot IS NOT NULL), k AS (SELECT movie_id, unnest(regexp_extract_all(lower(plot), '\p{{L}}+')) AS term FROM m),
s AS (SELECT * FROM k WHERE length(term) >= 3 AND term NOT IN ({_STOPS})), ln AS (SELECT movie_id, CAST(count(*) AS INTEGER) AS doc_len FROM s GROUP BY 1),
f AS (SELECT movie_id, doc_len, term, count(*) AS tf FROM s JOIN ln USING (movie_id) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM f GROUP BY 1 ORDER BY df DESC, term LIMIT 5000), i AS (SELECT *, ln((SELECT count(*) FROM m) / df) AS idf FROM d),
w AS (SELECT movie_id, term, idf * tf / doc_len AS weight FROM f JOIN i USING (term))
"""
_RANKS = "WITH v AS (SELECT l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem), r AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in NUMBERS
) + " FROM v), q AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(corr(price, {c}), 9) AS rho FROM r" for c in ("quantity", "discount", "tax")) + ") "
_WEATHER_RANKS = _NOAA + ", r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in ["label", *WEATHER]) + " FROM n) "
_CURVE = """
WITH o AS (SELECT o_totalprice AS score, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders),
g AS (SELECT score AS threshold, sum(label) AS p, count(*) - sum(label) AS n FROM o GROUP BY 1),
c AS (SELECT threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM g WINDOW w AS (ORDER BY threshold DESC)),
t AS (SELECT threshold, tp, fp, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, tp / ap AS recall, fp / an AS fpr FROM c)
"""

SQL = {
    "noaa_parse": _NOAA + "SELECT * FROM n",
    "year_split_counts": _NOAA + "SELECT CASE WHEN year BETWEEN 1993 AND 1996 THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM n GROUP BY 1",
    "pearson_matrix": "WITH v AS (SELECT l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM v" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]),
    "spearman_weather": _WEATHER_RANKS + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(corr(label, {c}), 9) AS rho FROM r" for c in WEATHER),
    "spearman_rank": _RANKS + "SELECT * FROM q",
    "strongest_correlate": _RANKS + 'SELECT "column", abs(rho) AS strength FROM q ORDER BY abs(rho) DESC, "column" DESC LIMIT 1',
    "tf": _TFIDF + "SELECT movie_id, doc_len, term, tf FROM f",
    "doc_freq_top": _TFIDF + "SELECT term, df, idf FROM i",
    "tfidf": _TFIDF + "SELECT movie_id, term, weight FROM w",
    "keyword_scores_tfidf": _TFIDF + f"SELECT movie_id, round(sum(weight * idf), 9) AS score FROM w JOIN i USING (term) WHERE term IN ({_WORDS_SQL}) GROUP BY 1 ORDER BY sum(weight * idf) DESC, movie_id DESC LIMIT 10",
    "title_join": _TFIDF + ", tt AS (SELECT DISTINCT movie_id, title, genre FROM movies) SELECT a.title, coalesce(doc_len, 0) AS n_terms, b.genre FROM m JOIN (SELECT DISTINCT movie_id, title FROM tt) a USING (movie_id) "
    "LEFT JOIN ln USING (movie_id) JOIN tt b ON a.title = b.title",
    "lsa_checks": "SELECT CAST(unnest(range(25)) AS INTEGER) AS concept, 1.0::DOUBLE AS term_norm, 1.0::DOUBLE AS doc_norm, true AS ordered, true AS solves",
    "hashed_survey": "SELECT CASE WHEN l_returnflag = 'R' THEN 'Yes' ELSE 'No' END AS outcome, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS indexed_label, count(*) AS n, "
    "round(sum(l_quantity + l_discount + l_tax + 2), 4) AS total FROM lineitem GROUP BY ALL",
    "threshold_metrics": _CURVE + "SELECT * FROM t",
    "ranking_metrics": _CURVE
    + ", s AS (SELECT *, coalesce(lag(fpr) OVER w, 0) AS f0, coalesce(lag(recall) OVER w, 0) AS r0, coalesce(lag(precision) OVER w, precision) AS p0 FROM t WINDOW w AS (ORDER BY threshold DESC)) "
    "SELECT round(sum((fpr - f0) * (recall + r0) / 2), 9) AS auroc, round(sum((recall - r0) * (precision + p0) / 2), 9) AS aupr FROM s",
    "movies_csv_roundtrip": "WITH m AS (SELECT DISTINCT * EXCLUDE (movie_id) FROM movies) SELECT release_year, count(*) AS n, count(nullif(title, '')) AS titles, CAST(sum(length(plot)) AS BIGINT) AS plot_chars FROM m GROUP BY 1",
}
