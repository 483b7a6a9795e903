"""Tokens and their predicates as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The predicates' patterns.
STRICT = r"\A(?:([a-z][a-z_-]*)?|\d+(\.\d+)?|\.\d+)\z"
WORD = r"\A[a-z_-]*\z"
NUMBER = r"\A(\d+(\.\d+)?|\.\d+)\z"
HASHTAG = r"\A#[A-Za-z0-9]*\z"
#: Words left out by default where stop-words are asked for.
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "in", "on", "to", "for", "with", "by", "is", "near", "her", "his", "its")


def lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, line_no (from 0), line: the text's lines, whichever way they end; a null text has none."""
    return df.select(*keep, F.posexplode(F.split(F.col(text), "\r\n|\n|\r")).alias("line_no", "line"))


def space_tokens(line: Column) -> Column:
    """Tokens between single spaces; empty ones at the end are dropped, others kept; an empty line is one empty token, blanks alone none."""
    return F.when(line == "", F.array(F.lit(""))).when(F.rtrim(line) == "", F.array().cast("array<string>")).otherwise(F.split(F.rtrim(line), " "))


def is_strict(token: Column) -> Column:
    """Lower-case word that begins with a letter, number, or empty."""
    return token.rlike(STRICT)


def is_word(token: Column) -> Column:
    """Letters a-z, hyphens and underscores only; the empty token too."""
    return token.rlike(WORD)


def is_number(token: Column) -> Column:
    return token.rlike(NUMBER)


def is_hashtag(token: Column) -> Column:
    """A # followed by letters and digits only, or alone."""
    return token.rlike(HASHTAG)


def token_kind(token: Column) -> Column:
    return F.when(is_word(token), "word").when(is_number(token), "number").otherwise("other")


def quoted(text: Column) -> Column:
    """The text in double quotes; a null becomes the quoted word null."""
    return F.concat(F.lit('"'), F.coalesce(text, F.lit("null")), F.lit('"'))


def joined(items: Column, sep: str = ",") -> Column:
    """An array as one text; null items are left out."""
    return F.array_join(items, sep)


def parted(text: Column, sep: str = ",") -> Column:
    """The array that ``joined`` wrote; an empty text is an empty array."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\\Q" + sep + "\\E"))


def separated(df: DataFrame, column: str, into: list[str], sep: str = ":") -> DataFrame:
    """Replaces a delimited column by one column per part; the last takes what is left, missing parts are null."""
    parts = F.split(F.col(column), "\\Q" + sep + "\\E", len(into))
    new = [F.get(parts, F.lit(k)).alias(c) for k, c in enumerate(into)]
    return df.select(*[x for c in df.columns for x in (new if c == column else [F.col(c)])])


def annotated(df: DataFrame, text: str, make: Callable[[], Callable[[str], list[str]]], out: str = "terms") -> DataFrame:
    """Adds ``out``, an array of terms per text, by a function that ``make`` builds once per partition (a language model, a lemmatiser); a null text has none."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annotate = None
        for b in batches:
            annotate = annotate or make()
            terms = [annotate(x) if x is not None else [] for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(terms, pa.list_(pa.string()))], [*b.schema.names, out])

    return df.mapInArrow(run, schema)


def letters_only(text: Column, min_length: int = 3) -> Column:
    """Lower-case runs of letters of at least ``min_length``: the default stand-in for lemmas. A null text has none."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)), lambda t: F.length(t) >= min_length)
