"""How distinctive a term is of a record, from joint and marginal counts by group-bys and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, join_per_key
from .terms import listed_terms, one_row_per_record, with_term_counts

#: Exponent that smooths the records' (contexts') shares, so that short records don't make every term look distinctive.
SMOOTHING = 0.75


def distinctive_terms(df: DataFrame, record: str, text: str, terms=listed_terms, empty_counts: bool = False, smoothing: float = SMOOTHING) -> DataFrame:
    """record, term, n, n_record, n_term, records_with, records, pmi, ppmi, share_idf: one row per record and distinct term.

    pmi is ln(p(term, record) / (p(term) p*(record))), where p*(record) is proportional to n_record to the power ``smoothing``; ppmi is
    pmi cut at zero. share_idf is n / n_record x ln(records / records_with), from the same counts. ``records`` counts the records with
    at least one term or, with ``empty_counts``, with a text that is not blank. Rows of one record count once; an empty input or a record without
    terms gives no rows. A term in every record has share_idf 0; other columns are ignored.
    """
    texts = one_row_per_record(df, record, text).where(F.col("text").rlike(r"[^\s\p{Z}]"))
    # read, made unique and counted once: the margins and the joint counts both come from here
    rec = cut(with_term_counts(texts, terms(F.col("text"))).select("record", "c", F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("n_record")))
    size = F.pow(F.col("n_record").cast("double"), F.lit(smoothing))
    # The collection's totals travel with the term counts, as the row of a term that cannot occur.
    total = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.col("n_record").alias("n"), size.alias("z")))
    each = F.transform("c", lambda x: F.struct(x["term"].alias("term"), x["n"].cast("bigint").alias("n"), F.lit(0.0).alias("z")))
    emitted = rec.select(F.explode(F.when(F.lit(empty_counts) | (F.col("n_record") > 0), F.concat(total, each))).alias("e"))
    margins = cut(emitted.groupBy("e.term").agg(F.sum("e.n").alias("n_term"), F.count("*").alias("records_with"), F.sum("e.z").alias("z")))
    totals = margins.where("term is null").select(F.struct(F.col("n_term").alias("n_all"), F.col("records_with").alias("records"), F.col("z").alias("z_all"))).scalar()
    joint = rec.select("record", "n_record", F.explode("c").alias("e")).select("record", "n_record", "e.term", "e.n")
    # A vocabulary proven small is broadcast, and the rows stay where their record is; beyond that only its frequent terms are, and the rest is shuffled by term.
    scored = join_per_key(joint, margins.where("term is not null").select("term", "n_term", "records_with"), "term", "records_with").withColumn("all", totals)
    pmi = F.log(F.col("n") / F.col("n_term")) - F.log(size / F.col("all.z_all"))
    idf = F.log(F.col("all.records") / F.col("records_with"))
    return scored.select(
        F.col("record").alias(record), "term", "n", "n_record", "n_term", "records_with", F.col("all.records").alias("records"),
        pmi.alias("pmi"), F.greatest(pmi, F.lit(0.0)).alias("ppmi"), (F.col("n") / F.col("n_record") * idf).alias("share_idf"),
    )


def top_terms(scored: DataFrame, record: str, score: str = "share_idf") -> DataFrame:
    """record, term, score: each record's highest-scoring terms, all of them if equal (to a relative 1e-12); no group exceeds one record's terms."""
    best = Window.partitionBy(record)
    return (
        scored.select(record, "term", F.col(score).alias("score"))
        .withColumn("best", F.max("score").over(best))
        .where(F.col("score") >= F.col("best") - F.abs("best") * 1e-12)
        .select(record, "term", "score")
    )
