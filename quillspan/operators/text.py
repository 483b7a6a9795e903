"""Counts of tokens, pairs and stripes: narrow expressions up to one aggregation with partial sums."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import is_hashtag, is_strict, lines, space_tokens, token_kind


def tokens_of(df: DataFrame, text: str, lower: bool = False) -> DataFrame:
    """token: every token of every line."""
    t = lines(df, text).select(F.explode(space_tokens(F.col("line"))).alias("token"))
    return t.select(F.lower("token").alias("token")) if lower else t


def count_tokens(tokens: DataFrame, keep: Column | None = None) -> DataFrame:
    """token, cnt"""
    t = tokens if keep is None else tokens.where(keep)
    return t.groupBy("token").agg(F.count("*").alias("cnt"))


def without(tokens: DataFrame, stop_words: DataFrame | Iterable[str]) -> DataFrame:
    """Tokens that are no stop-words. Given words go into the plan as a set; a table is anti-joined, as the optimizer sees fit."""
    if isinstance(stop_words, DataFrame):
        return tokens.join(stop_words.select(F.col(stop_words.columns[0]).alias("token")), "token", "left_anti")
    return tokens.where(~F.col("token").isin(*stop_words))


def top(df: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    """The n rows with the greatest ``by``; ties are settled by the other columns in order."""
    return df.orderBy(F.desc(by), *ties).limit(n)


def _marked_lines(df: DataFrame, text: str) -> DataFrame:
    """t: each line's tokens, null where rejected (they keep their place), so each token is tested once."""
    return lines(df, text).select(F.transform(space_tokens(F.col("line")), lambda x: F.when(is_strict(x), x)).alias("t"))


def _shifted(m: int, struct) -> Column:
    """All (token, token d places to the right), d from 1 to m, of one line."""
    n = F.size("t")
    parts = [F.zip_with(F.slice("t", F.lit(1), F.greatest(n - d, F.lit(0))), F.slice("t", F.lit(d + 1), F.greatest(n - d, F.lit(0))), struct) for d in range(1, m + 1)]
    return F.flatten(F.array(*parts))


def word_pairs(df: DataFrame, text: str, m: int = 1, keep_empty: bool = False) -> DataFrame:
    """pair (``left:right``), cnt: ordered pairs of accepted tokens up to m places apart within a line.

    Rejected tokens count for the distance. With ``keep_empty`` only the right token must not be empty, otherwise neither may be.
    """
    pair = F.explode(_shifted(m, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p")
    p = _marked_lines(df, text).select(pair).select("p.a", "p.b").where("a is not null and b <> ''")
    if not keep_empty:
        p = p.where("a <> ''")
    return p.groupBy("a", "b").agg(F.count("*").alias("cnt")).select(F.concat_ws(":", "a", "b").alias("pair"), "cnt", "a", "b")


def pair_kinds(pairs: DataFrame) -> DataFrame:
    """Adds kind: word-word, number-number or mixed."""
    a, b = token_kind(F.col("a")), token_kind(F.col("b"))
    return pairs.withColumn("kind", F.when(a != b, "mixed").otherwise(F.concat_ws("-", a, b)))


def word_stripes(df: DataFrame, text: str, m: int = 1) -> DataFrame:
    """token, neighbour, cnt: accepted tokens up to m places to either side; the centre must not be empty, a neighbour may be."""
    pair = F.explode(_shifted(m, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p")
    right = _marked_lines(df, text).select(pair).select("p.a", "p.b").where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("cnt"))
    # each pair is counted once, to the right, and mirrored afterwards: half the rows go through the first aggregation
    sides = F.array(F.struct(F.col("a").alias("token"), F.col("b").alias("neighbour")), F.struct(F.col("b").alias("token"), F.col("a").alias("neighbour")))
    both = right.select(F.explode(sides).alias("s"), "cnt").select("s.token", "s.neighbour", "cnt").where("token <> ''")
    return both.groupBy("token", "neighbour").agg(F.sum("cnt").alias("cnt"))


def as_stripes(flat: DataFrame) -> DataFrame:
    """token, stripe: the neighbours' counts as a map."""
    return flat.groupBy("token").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("neighbour", "cnt")))).alias("stripe"))


def hashtags_of(df: DataFrame, text: str) -> DataFrame:
    """tags: the hashtags of each text, sorted, repeats kept."""
    return df.select(F.array_sort(F.filter(F.split(F.col(text), " "), is_hashtag)).alias("tags"))


def hashtag_counts(tweets: DataFrame) -> DataFrame:
    """token, cnt"""
    return count_tokens(tweets.select(F.explode("tags").alias("token")))


def hashtag_pairs(tweets: DataFrame) -> DataFrame:
    """pair, cnt: distinct unordered pairs per text; a tag pairs with itself once if it is repeated."""
    t = tweets.select("tags", F.array_distinct("tags").alias("u"))
    unlike = F.flatten(F.transform("u", lambda x, i: F.transform(F.slice("u", i + 2, F.greatest(F.size("u"), F.lit(1))), lambda y: F.concat_ws(":", x, y))))
    alike = F.array_distinct(F.array_compact(F.zip_with("tags", F.slice("tags", F.lit(2), F.greatest(F.size("tags"), F.lit(1))), lambda a, b: F.when(a == b, F.concat_ws(":", a, a)))))
    return t.select(F.explode(F.concat(unlike, alike)).alias("pair")).groupBy("pair").agg(F.count("*").alias("cnt"))
