"""Queries of the training-data problems (p1, p5, p8, p9, p10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import cut, table
from .chunking import split_oversized
from .distinctive import distinctive_terms, top_terms
from .frequency import term_frequencies
from .mixing import mix, quotas, reached_shares, shard_shares
from .packing import pack
from .terms import word_terms


def _limit(spark: SparkSession, sf: str, purpose: str) -> tuple[int, int]:
    r = table(spark, sf, "size_limits").where(F.col("purpose") == purpose).first()
    return int(r["max_tokens"]), int(r["overlap_tokens"])


def p1_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return term_frequencies(table(spark, sf, "movie_features"), "movie_id", "features")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_frequencies(spark, sf).where("mark is not null").select("term", "mark")


def _scored(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [
        distinctive_terms(table(spark, sf, "movie_features"), "movie_id", "features"),
        distinctive_terms(table(spark, sf, "movies"), "movie_id", "title", word_terms, empty_counts=True),
    ]


def p5_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every term of every movie with its scores."""
    features, title = _scored(spark, sf)
    both = features.withColumn("field_name", F.lit("features")).unionByName(title.withColumn("field_name", F.lit("title")))
    return both.withColumns({c: F.round(c, 9) for c in ("pmi", "ppmi", "share_idf")})


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    features, title = [top_terms(s, "movie_id").select("movie_id", "term") for s in _scored(spark, sf)]
    return features.select(F.lit("features").alias("field_name"), "*").unionByName(title.select(F.lit("title").alias("field_name"), "*"))


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"), "doc_id", "text", _limit(spark, sf, "container")[0])


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents"), "doc_id", "text", "source", table(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return reached_shares(p9_mixture(spark, sf), table(spark, sf, "mix_targets"))


#: Rows of a group in p8_checks, so few that the tree of levels is run on every table size.
SMALL_GROUP = 128


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, n_tokens, divided, whole, fits, tight: what must hold of each document when they are packed through the tree.

    Whole: its pieces follow each other from its first token on. Fits: its containers hold no more than they can, without gaps or overlaps. Tight: all
    containers together are at least 98 percent full, one aside.
    """
    capacity = _limit(spark, sf, "container")[0]
    p = cut(pack(table(spark, sf, "documents"), "doc_id", "text", capacity, group_items=SMALL_GROUP).where("container is not null"))
    inner, pieces = Window.partitionBy("container").orderBy("at"), Window.partitionBy("doc_id").orderBy("piece")
    p = p.withColumn("follows", F.col("at") == F.coalesce(F.lag(F.col("at") + F.col("n_tokens")).over(inner), F.lit(0)))
    p = p.withColumn("held", F.max(F.col("at") + F.col("n_tokens")).over(Window.partitionBy("container")))
    p = p.withColumn("next", F.col("start_token") == F.coalesce(F.lag(F.col("start_token") + F.col("n_tokens")).over(pieces), F.lit(0)))
    fill = p.agg((F.sum("n_tokens") >= 0.98 * capacity * (F.count_distinct("container") - 1)).alias("tight"))  # one row
    d = p.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), (F.count("*") > 1).alias("divided"), F.every("next").alias("whole"), F.every(F.col("follows") & (F.col("held") <= capacity)).alias("fits"))
    return d.join(F.broadcast(fill))


def p9_checks(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, source, n_tokens, quota_tokens, within_repeats, reached, in_every_shard: what must hold of each document whose source is in the mixture, and of that source.

    Within repeats: no copy comes twice and none beyond max_repeats. Reached: the source's tokens are its quota, or more by part of one document. In every shard
    (of four): they are a fourth of it, to a tenth or the source's largest document.
    """
    docs, targets, shards = table(spark, sf, "documents"), table(spark, sf, "mix_targets"), 4
    m = cut(mix(docs, "doc_id", "text", "source", targets, shards=shards))
    d = docs.select("doc_id", F.lower(F.trim("source")).alias("source"), F.octet_length("text").cast("bigint").alias("size")).where("size > 0")
    most = d.groupBy("source").agg(F.max("size").alias("largest"), F.sum("size").alias("n"))
    quota = quotas({r["source"]: r["n"] for r in most.where("source is not null").collect()}, [tuple(r) for r in targets.select("source", "target_share", "max_repeats").collect()])  # one row per source
    limits = spark.createDataFrame(list(quota.items()), "source string, quota double").join(most, "source").join(targets.select(F.lower(F.trim("source")).alias("source"), "max_repeats"), "source")
    by_shard = shard_shares(m).join(limits, "source").withColumn("off", F.abs(F.col("n_tokens") - F.col("quota") / shards) > F.greatest(F.col("quota") / shards / 10, F.col("largest")))
    held = by_shard.groupBy("source").agg(F.sum("n_tokens").alias("got"), F.count_if("off").alias("off"), F.count("*").alias("in_shards"))
    every = (F.col("off") == 0) & ((F.col("in_shards") == shards) | (F.col("quota") / shards <= F.col("largest")))
    of_source = limits.join(held, "source").select(
        "source", "max_repeats", F.round("quota").cast("bigint").alias("quota_tokens"), F.col("got").between(F.floor("quota"), F.ceil("quota") + F.col("largest")).alias("reached"), every.alias("in_every_shard")
    )
    used = m.groupBy("doc_id").agg(F.count("*").alias("times"), F.max("copy").alias("copies"), F.count_distinct("copy").alias("different"), F.max("n_tokens").alias("n"))
    fine = (F.col("times") == F.col("different")) & (F.col("copies") <= F.col("max_repeats")) & (F.col("n") == F.col("size"))
    return d.join(F.broadcast(of_source), "source").join(used, "doc_id", "left").select(  # one row per target
        "doc_id", "source", F.col("size").alias("n_tokens"), "quota_tokens", F.coalesce(fine, F.lit(True)).alias("within_repeats"), "reached", "in_every_shard"
    )


def p10_checks(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, n_tokens, first_start, whole, within_limit, overlapping, exact: what must hold of each divided document's pieces, and the size they add up to."""
    limit, overlap = _limit(spark, sf, "piece")
    w = Window.partitionBy("doc_id").orderBy("piece")
    docs = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    p = p10_pieces(spark, sf).withColumn("before", F.lag("end_token").over(w)).join(docs, "doc_id")
    new = F.col("start_token") + F.col("overlap_tokens")
    repeats = F.when(F.col("before").isNull(), F.col("overlap_tokens") == 0).otherwise(F.col("overlap_tokens").between(F.least(F.lit(overlap), "before"), overlap + 3))
    return p.groupBy("doc_id").agg(
        F.sum(F.col("n_tokens") - F.col("overlap_tokens")).alias("n_tokens"), F.min("start_token").alias("first_start"), F.every(new == F.coalesce("before", F.lit(0))).alias("whole"),
        F.every(F.col("n_tokens") <= limit).alias("within_limit"), F.every(repeats).alias("overlapping"),
        F.every(F.encode("text", "UTF-8") == F.substring("data", F.col("start_token").cast("int") + 1, F.col("n_tokens").cast("int"))).alias("exact"),
    )


def p10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    limit, overlap = _limit(spark, sf, "piece")
    return split_oversized(table(spark, sf, "documents"), "doc_id", "text", limit, overlap)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_pieces(spark, sf).where("piece = 2").select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_frequencies, p5_found, p5_scores, p8_containers, p8_checks, p9_mixture, p9_shares, p9_checks, p10_found, p10_pieces, p10_checks)}

_TERMS = r"""
WITH f AS (SELECT movie_id, min(features) AS features FROM movie_features GROUP BY movie_id),
b AS (SELECT movie_id, CASE WHEN regexp_full_match(features, '(?s)\s*[A-Za-z]*\(.*\)\s*') OR regexp_full_match(features, '(?s)\s*\[.*\]\s*')
      THEN regexp_replace(features, '(?s)^\s*(?:[A-Za-z]*\(|\[)(.*)[\])]\s*$', '\1') ELSE features END AS x FROM f),
u AS (SELECT movie_id, regexp_replace(unnest(string_split(lower(x), ',')), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS term FROM b),
w AS (SELECT movie_id, term FROM u WHERE term <> '')
"""
_FREQ = _TERMS + """, c AS (SELECT term, count(*) AS occurrences, count(DISTINCT movie_id) AS records FROM w GROUP BY term),
r AS (SELECT *, records / (SELECT count(DISTINCT movie_id) FROM w) AS share, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.2 * (SELECT count(DISTINCT movie_id) FROM w) THEN 'common' END AS mark FROM c)
"""
_DISTINCT = _TERMS + r""", titles AS (SELECT movie_id, min(title) AS title FROM movies GROUP BY movie_id),
titled AS (SELECT * FROM titles WHERE regexp_matches(title, '[^\s\p{Z}]')),
tw AS (SELECT movie_id, unnest(regexp_extract_all(lower(title), '[\p{L}\p{M}\p{Nd}]+')) AS term FROM titled),
al AS (SELECT 'features' AS field_name, movie_id, term FROM w UNION ALL SELECT 'title', movie_id, term FROM tw),
sz AS (SELECT 'features' AS field_name, count(DISTINCT movie_id) AS total FROM w UNION ALL SELECT 'title', count(*) FROM titled),
tf AS (SELECT field_name, movie_id, term, count(*) AS n FROM al GROUP BY ALL),
ln AS (SELECT field_name, movie_id, count(*) AS len FROM al GROUP BY ALL),
df AS (SELECT field_name, term, count(*) AS d FROM tf GROUP BY ALL),
sc AS (SELECT field_name, movie_id, term, n, len, d, total, n / len * ln(total / d) AS score FROM tf JOIN ln USING (field_name, movie_id) JOIN df USING (field_name, term) JOIN sz USING (field_name))
"""
_BEST = _DISTINCT + """, mx AS (SELECT *, max(score) OVER (PARTITION BY field_name, movie_id) AS best FROM sc)
SELECT field_name, movie_id, term FROM mx WHERE score >= best - abs(best) * 1e-12
"""
_SCORES = _DISTINCT + """, tm AS (SELECT field_name, term, CAST(sum(n) AS BIGINT) AS n_term FROM tf GROUP BY ALL), zs AS (SELECT field_name, sum(pow(len, 0.75)) AS z FROM ln GROUP BY ALL),
pm AS (SELECT *, ln(n / n_term) - ln(pow(len, 0.75) / z) AS pmi FROM sc JOIN tm USING (field_name, term) JOIN zs USING (field_name))
SELECT field_name, movie_id, term, n, len AS n_record, n_term, d AS records_with, total AS records, round(pmi, 9) AS pmi, round(greatest(pmi, 0), 9) AS ppmi, round(score, 9) AS share_idf FROM pm
"""
_SIZES = """
SELECT doc_id, octet_length(encode(text)) AS n_tokens, octet_length(encode(text)) > (SELECT max_tokens FROM size_limits WHERE purpose = 'container') AS divided, true AS whole, true AS fits, true AS tight
FROM documents WHERE octet_length(encode(text)) > 0
"""
_QUOTAS = """
WITH d AS (SELECT doc_id, lower(trim(source)) AS source, octet_length(encode(text)) AS n_tokens FROM documents WHERE octet_length(encode(text)) > 0), s AS (SELECT source, sum(n_tokens) AS n FROM d GROUP BY 1),
t AS (SELECT lower(trim(m.source)) AS source, target_share, max_repeats, n FROM mix_targets m JOIN s ON s.source = lower(trim(m.source))),
g AS (SELECT min(n * max_repeats * (SELECT sum(target_share) FROM t) / target_share) AS goal FROM t)
SELECT doc_id, source, n_tokens, CAST(round(goal * target_share / (SELECT sum(target_share) FROM t)) AS BIGINT) AS quota_tokens, true AS within_repeats, true AS reached, true AS in_every_shard
FROM d JOIN t USING (source), g
"""
SQL = {
    "p1_found": _FREQ + "SELECT term, mark FROM r WHERE mark IS NOT NULL",
    "p1_frequencies": _FREQ + "SELECT term, occurrences, records, share, mark FROM r",
    "p5_found": _BEST,
    "p5_scores": _SCORES,
    "p8_checks": _SIZES,
    "p9_checks": _QUOTAS,
    "p10_checks": "SELECT doc_id, octet_length(encode(text)) AS n_tokens, CAST(0 AS BIGINT) AS first_start, true AS whole, true AS within_limit, true AS overlapping, true AS exact FROM documents "
    "WHERE octet_length(encode(text)) > (SELECT max_tokens FROM size_limits WHERE purpose = 'piece')",
    "p10_found": "SELECT doc_id FROM documents WHERE octet_length(encode(text)) > (SELECT max_tokens FROM size_limits WHERE purpose = 'piece')",
}
