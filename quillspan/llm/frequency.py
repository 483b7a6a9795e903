"""Frequency of every distinct term of a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .terms import listed_terms, one_row_per_record, with_term_counts


def term_frequencies(df: DataFrame, record: str, text: str, rare_below: int = 3, common_above: float = 0.2, terms=listed_terms) -> DataFrame:
    """term, occurrences, records, share, mark: one row per distinct term of the whole collection.

    Each record emits its terms with their counts; the counts are combined by hash on every partition before the shuffle and summed
    after it, so a term in every record costs one row per partition. mark is ``rare`` for a term in fewer than ``rare_below`` records,
    else ``common`` for one in more than ``common_above`` of all records with at least one term, else null. Repeated rows of a record
    count once; records that are null or without terms don't count; an empty input gives no rows. Other columns are ignored.
    """
    counts = with_term_counts(one_row_per_record(df, record, text), terms(F.col("text")))
    # The number of records with terms travels as the count of a term that cannot occur, so that the collection is read once. No filter on
    # the counts themselves: it would be pushed below, and the terms found anew for every element.
    one = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("n")))
    emitted = counts.select(F.explode(F.when(F.size("c") > 0, F.concat(one, "c"))).alias("e"))
    freq = cut(emitted.groupBy("e.term").agg(F.sum("e.n").alias("occurrences"), F.count("*").alias("records")))
    total = freq.where("term is null").select("records").scalar()
    marked = freq.where("term is not null").withColumn("total", total)
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_above) * F.col("total"), "common")
    return marked.select("term", "occurrences", "records", (F.col("records") / F.col("total")).alias("share"), mark.alias("mark"))
