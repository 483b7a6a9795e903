"""Terms of records: reading them from text and counting them within a record, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What printing a collection leaves around its items (fixed values): a name and brackets, or square brackets alone.
WRAPPER = r"(?s)\A\s*(?:(?:[A-Za-z]+)?\((.*)\)|\[(.*)\])\s*\z"


def listed_terms(text: Column) -> Column:
    """Array of the comma-separated terms: wrapper taken off, trimmed, lower case, empty ones left out; null text gives an empty array."""
    bare = F.when(text.rlike(WRAPPER), F.regexp_replace(text, WRAPPER, "$1$2")).otherwise(text)
    parts = F.transform(F.split(F.lower(bare), ","), lambda x: F.regexp_replace(x, r"\A[\s\p{Z}]+|[\s\p{Z}]+\z", ""))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def word_terms(text: Column) -> Column:
    """Array of the maximal runs of letters and digits, in lower case; null text gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{Nd}]+"), F.lit(0)), F.array().cast("array<string>"))


def with_term_counts(df: DataFrame, terms: Column) -> DataFrame:
    """Adds ``c``, an array of (term, n): how often each term occurs in the row, by one sort of its terms and one pass over them.

    Each step is a column of its own: an expression repeated inside a lambda would be computed anew for every element.
    """
    sorted_terms = df.withColumn("_s", F.array_sort(terms))
    new = lambda x, i: (i == 0) | (x != F.get("_s", i - 1))
    starts = sorted_terms.withColumn("_p", F.array_compact(F.transform("_s", lambda x, i: F.when(new(x, i), i))))
    runs = F.transform("_p", lambda p, k: F.struct(F.get("_s", p).alias("term"), (F.coalesce(F.get("_p", k + 1), F.size("_s")) - p).alias("n")))
    return starts.withColumn("c", runs).drop("_s", "_p")


def one_row_per_record(df: DataFrame, record: str, text: str) -> DataFrame:
    """record, text: repeated rows count once; of different texts of one record the first in order is taken, nulls last."""
    return df.where(F.col(record).isNotNull()).groupBy(F.col(record).alias("record")).agg(F.min(text).alias("text"))
