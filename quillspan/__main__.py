"""Command line: counting words, pairs and stripes of text folders, hashtags of a stream, and the registered queries.

    python -m quillspan word-count INPUT OUTPUT [--top N] [--stop-words FILE]
    python -m quillspan word-pairs INPUT OUTPUT [-m M]
    python -m quillspan word-stripes INPUT OUTPUT [-m M]
    python -m quillspan hashtags INPUT OUTPUT [--window SECONDS] [--timeout SECONDS]
    python -m quillspan query NAME TABLES OUTPUT
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.tokens import is_word
from .operators import text as X
from .plans import analysis_queries, problems, text_queries, trip_queries
from .runtime import ship
from .sources import readers, sinks
from .streaming.hashtags import hashtag_batches


def timed(work: Callable[[], None]) -> float:
    """Runs the work and prints how long it took, in minutes and seconds; returns the seconds."""
    began = time.perf_counter()
    work()
    took = time.perf_counter() - began
    print(f"{int(took // 60)} min {took % 60:.1f} s")
    return took


def _counts(spark: SparkSession, a: argparse.Namespace) -> None:
    t = X.tokens_of(readers.read_lines(spark, a.input, recursive=True).withColumnRenamed("value", "text"), "text", lower=True)
    t = X.without(t, readers.read_stop_words(spark, a.stop_words)) if a.stop_words else t
    c = X.count_tokens(t, is_word(F.col("token")))
    sinks.write_tsv(X.top(c, a.top, "cnt", "token") if a.top else c, a.output)


def _lines(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return readers.read_lines(spark, a.input, recursive=True).withColumnRenamed("value", "text")


def _hashtags(spark: SparkSession, a: argparse.Namespace) -> None:
    stream = spark.readStream.option("recursiveFileLookup", True).text(a.input)
    how = {"every": f"{a.window} seconds", "timeout_s": a.timeout} if a.timeout else {}
    hashtag_batches(stream, "value", a.output, **how)


def _query(spark: SparkSession, a: argparse.Namespace) -> None:
    known = {k: f for m in (text_queries, trip_queries, analysis_queries, problems) for k, f in m.QUERIES.items()} | analysis_queries.SLOW
    if a.name not in known:
        raise SystemExit(f"no query {a.name}; there are: {', '.join(sorted(known))}")
    ship(spark)
    known[a.name](spark, a.tables).write.parquet(a.output)


def main(argv: list[str] | None = None) -> float:
    parser = argparse.ArgumentParser(prog="quillspan")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("word-count", "word-pairs", "word-stripes", "hashtags"):
        p = sub.add_parser(name)
        p.add_argument("input")
        p.add_argument("output")
        if name == "word-count":
            p.add_argument("--top", type=int)
            p.add_argument("--stop-words")
        elif name == "hashtags":
            p.add_argument("--window", type=int, default=60)
            p.add_argument("--timeout", type=float)
        else:
            p.add_argument("-m", type=int, default=1)
    q = sub.add_parser("query")
    for x in ("name", "tables", "output"):
        q.add_argument(x)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quillspan").getOrCreate()
    work = {
        "word-count": lambda: _counts(spark, a), "hashtags": lambda: _hashtags(spark, a), "query": lambda: _query(spark, a),
        "word-pairs": lambda: sinks.write_tsv(X.word_pairs(_lines(spark, a), "text", a.m).select("pair", "cnt"), a.output),
        "word-stripes": lambda: sinks.write_stripes(X.as_stripes(X.word_stripes(_lines(spark, a), "text", a.m)), a.output),
    }
    return timed(work[a.command])


if __name__ == "__main__":
    main()
