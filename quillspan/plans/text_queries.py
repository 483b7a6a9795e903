"""Queries over the documents' lines and tweets, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import STOP_WORDS, is_number, is_strict, is_word, separated, token_kind
from ..operators import text as X
from ..runtime import spread, table
from ..streaming.hashtags import batch_path, merged_windows, on_batches, shared_path, window_counts


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("text", "source"))


def word_count_strict(spark: SparkSession, sf: str) -> DataFrame:
    return X.count_tokens(X.tokens_of(_docs(spark, sf), "text"), is_strict(F.col("token")) & (F.col("token") != ""))


def word_count_top1000(spark: SparkSession, sf: str) -> DataFrame:
    return X.top(X.count_tokens(X.tokens_of(_docs(spark, sf), "text", lower=True), is_word(F.col("token"))), 1000, "cnt", "token")


def number_count_top1000(spark: SparkSession, sf: str) -> DataFrame:
    return X.top(X.count_tokens(X.tokens_of(_docs(spark, sf), "text", lower=True), is_number(F.col("token"))), 1000, "cnt", "token")


def word_count_stopwords(spark: SparkSession, sf: str) -> DataFrame:
    t = X.without(X.tokens_of(_docs(spark, sf), "text", lower=True), STOP_WORDS)
    return X.top(X.count_tokens(t, is_word(F.col("token"))), 1000, "cnt", "token")


def word_count_stopwords_join(spark: SparkSession, sf: str) -> DataFrame:
    stop = spark.createDataFrame([(w,) for w in STOP_WORDS], "token string")
    t = X.without(X.tokens_of(_docs(spark, sf), "text", lower=True), stop)
    return X.top(X.count_tokens(t, is_word(F.col("token"))), 1000, "cnt", "token")


def token_kind_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = X.tokens_of(_docs(spark, sf), "text")
    return t.groupBy(token_kind(F.col("token")).alias("kind")).agg(F.count("*").alias("cnt"))


def _pairs(m: int):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return X.word_pairs(_docs(spark, sf), "text", m).select("pair", "cnt")

    return query


def word_pairs_keep_empty(spark: SparkSession, sf: str) -> DataFrame:
    return X.word_pairs(_docs(spark, sf), "text", 1, keep_empty=True).select("pair", "cnt")


def word_pairs_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return X.pair_kinds(X.word_pairs(_docs(spark, sf), "text", 1)).select("kind", "pair", "cnt")


def _stripes(m: int):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return X.word_stripes(_docs(spark, sf), "text", m)

    return query


def _tweets(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).where("lower(trim(source)) = 'tweets'")


def hashtag_top(spark: SparkSession, sf: str) -> DataFrame:
    return X.top(X.hashtag_counts(X.hashtags_of(_tweets(spark, sf), "text")), 1000, "cnt", "token")


def hashtag_pairs_top(spark: SparkSession, sf: str) -> DataFrame:
    return X.top(X.hashtag_pairs(X.hashtags_of(_tweets(spark, sf), "text")), 1000, "cnt", "pair")


def stream_hashtag_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Per-batch counts of a stream over the documents, added up over the batches: the batch query's answer."""
    schema = table(spark, sf, "documents").schema
    base = shared_path(spark, "hashtags")
    # a pattern, since a table may be one file or a folder of files
    tweets = spark.readStream.schema(schema).parquet(f"{sf}/documents.parque[t]").where("lower(trim(source)) = 'tweets'")

    def work(batch: DataFrame, batch_id: int) -> None:
        X.hashtag_counts(X.hashtags_of(batch, "text")).write.mode("overwrite").parquet(batch_path(f"{base}/counts", "batch", batch_id))

    spark.createDataFrame([], "token string, cnt bigint").write.parquet(f"{base}/counts/none")
    on_batches(tweets, work, f"{base}/checkpoint")
    counts = spark.read.option("recursiveFileLookup", True).schema("token string, cnt bigint").parquet(f"{base}/counts")
    return X.top(counts.groupBy("token").agg(F.sum("cnt").alias("cnt")), 1000, "cnt", "token")


def stream_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly event counts of a stream with a watermark, after the last batch; a year late is not too late, so that the order of the files doesn't matter."""
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")
    counts = merged_windows(window_counts(stream, "ts", "event_type", late="366 days"), shared_path(spark, "windows"), ["window_start", "event_type"])
    return counts.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "cnt")


def word_stripes_map(spark: SparkSession, sf: str) -> DataFrame:
    """token, neighbours, total: the stripes as maps, and what is in them."""
    s = X.as_stripes(X.word_stripes(_docs(spark, sf), "text", 1))
    total = F.aggregate(F.map_values("stripe"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return s.select("token", F.size("stripe").cast("bigint").alias("neighbours"), total.alias("total"), F.element_at("stripe", F.lit("the")).alias("beside_the"))


def word_pairs_separated(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the pairs' left parts, read back from the joined key."""
    p = separated(X.word_pairs(_docs(spark, sf), "text", 1).select("pair", "cnt"), "pair", ["a", "b"])
    return p.groupBy("a").agg(F.sum("cnt").alias("cnt"))


QUERIES = {
    f.__name__: f
    for f in (word_count_strict, word_count_top1000, number_count_top1000, word_count_stopwords, word_count_stopwords_join, token_kind_counts)
} | {f"word_pairs_m{m}": _pairs(m) for m in (1, 2, 5, 10)} | {f"word_stripes_m{m}": _stripes(m) for m in (1, 2, 5, 10)} | {
    f.__name__: f
    for f in (word_pairs_keep_empty, word_pairs_kinds, hashtag_top, hashtag_pairs_top, stream_hashtag_topk, stream_window_counts, word_stripes_map, word_pairs_separated)
}

_LINES = r"""
WITH l AS (SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS a FROM documents WHERE text IS NOT NULL)),
k AS (SELECT doc_id, line_no, CASE WHEN line = '' THEN [''] WHEN rtrim(line, ' ') = '' THEN [] ELSE string_split(rtrim(line, ' '), ' ') END AS a FROM l),
t AS (SELECT doc_id, line_no, unnest(range(len(a))) AS pos, unnest(a) AS token FROM k)
"""
_STRICT = r"regexp_full_match({0}, '([a-z][a-z_-]*)?|\d+(\.\d+)?|\.\d+')"
_WORD, _NUMBER = r"regexp_full_match({0}, '[a-z_-]*')", r"regexp_full_match({0}, '\d+(\.\d+)?|\.\d+')"
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_KIND = "CASE WHEN " + _WORD + " THEN 'word' WHEN " + _NUMBER + " THEN 'number' ELSE 'other' END"


def _top_sql(cond: str) -> str:
    return _LINES + f", w AS (SELECT lower(token) AS token FROM t) SELECT token, count(*) AS cnt FROM w WHERE {cond} GROUP BY token ORDER BY cnt DESC, token LIMIT 1000"


def _pairs_sql(m: int, left: str = "a.token <> '' AND ") -> str:
    return _LINES + (
        f", s AS (SELECT * FROM t WHERE {_STRICT.format('token')}), p AS (SELECT a.token AS a, b.token AS b, count(*) AS cnt FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.line_no = b.line_no "
        f"AND b.pos BETWEEN a.pos + 1 AND a.pos + {m} WHERE {left} b.token <> '' GROUP BY ALL) "
    )


def _stripes_sql(m: int) -> str:
    return _LINES + (
        f", s AS (SELECT * FROM t WHERE {_STRICT.format('token')}) SELECT a.token AS token, b.token AS neighbour, count(*) AS cnt FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.line_no = b.line_no "
        f"AND a.pos <> b.pos AND abs(a.pos - b.pos) <= {m} WHERE a.token <> '' GROUP BY ALL"
    )


_TAGS = r"""
WITH d AS (SELECT doc_id, string_split(text, ' ') AS a FROM documents WHERE lower(trim(source)) = 'tweets'), u AS (SELECT doc_id, unnest(a) AS token FROM d),
h AS (SELECT doc_id, token FROM u WHERE regexp_full_match(token, '#[A-Za-z0-9]*')), c AS (SELECT doc_id, token, count(*) AS n FROM h GROUP BY ALL)
"""
_TAG_TOP = _TAGS + "SELECT token, count(*) AS cnt FROM h GROUP BY token ORDER BY cnt DESC, token LIMIT 1000"

SQL = {
    "word_count_strict": _LINES + f"SELECT token, count(*) AS cnt FROM t WHERE token <> '' AND {_STRICT.format('token')} GROUP BY token",
    "word_count_top1000": _top_sql(_WORD.format("token")),
    "number_count_top1000": _top_sql(_NUMBER.format("token")),
    "word_count_stopwords": _top_sql(f"{_WORD.format('token')} AND token NOT IN ({_STOPS})"),
    "word_count_stopwords_join": _top_sql(f"{_WORD.format('token')} AND token NOT IN ({_STOPS})"),
    "token_kind_counts": _LINES + f"SELECT {_KIND.format('token')} AS kind, count(*) AS cnt FROM t GROUP BY 1",
    **{f"word_pairs_m{m}": _pairs_sql(m) + "SELECT a || ':' || b AS pair, cnt FROM p" for m in (1, 2, 5, 10)},
    "word_pairs_keep_empty": _pairs_sql(1, "") + "SELECT a || ':' || b AS pair, cnt FROM p",
    "word_pairs_kinds": _pairs_sql(1)
    + f"SELECT CASE WHEN {_KIND.format('a')} <> {_KIND.format('b')} THEN 'mixed' ELSE {_KIND.format('a')} || '-' || {_KIND.format('b')} END AS kind, a || ':' || b AS pair, cnt FROM p",
    **{f"word_stripes_m{m}": _stripes_sql(m) for m in (1, 2, 5, 10)},
    "word_stripes_map": "WITH s AS (" + _stripes_sql(1) + ") SELECT token, count(*) AS neighbours, CAST(sum(cnt) AS BIGINT) AS total, max(cnt) FILTER (neighbour = 'the') AS beside_the FROM s GROUP BY token",
    "word_pairs_separated": _pairs_sql(1) + "SELECT a, CAST(sum(cnt) AS BIGINT) AS cnt FROM p GROUP BY a",
    "hashtag_top": _TAG_TOP,
    "hashtag_pairs_top": _TAGS
    + "SELECT x.token || ':' || y.token AS pair, count(*) AS cnt FROM c x JOIN c y ON x.doc_id = y.doc_id AND (x.token < y.token OR (x.token = y.token AND x.n > 1)) GROUP BY 1 ORDER BY cnt DESC, pair LIMIT 1000",
    "stream_hashtag_topk": _TAG_TOP,
    "stream_window_counts": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS cnt FROM events GROUP BY ALL",
}
