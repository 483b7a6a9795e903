"""Streams of short texts: per-batch hashtag and pair tops, archives, and event-time window counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.text import hashtag_counts, hashtag_pairs, hashtags_of, top
from ..runtime import ensure_checkpoint_dir
from ..sources.sinks import batch_path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the session's checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def on_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, timeout_s: float | None = None) -> None:
    """Runs ``work`` on every non-empty micro-batch: all that is available now, or with ``every`` by processing time until the timeout."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                work(batch, batch_id)
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    q = (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
    if timeout_s is None:
        q.awaitTermination()
    else:
        q.awaitTermination(timeout_s)
        q.stop()


def hashtag_batches(stream: DataFrame, text: str, base: str, n: int = 1000, archive: bool = True, **how) -> None:
    """Per batch, below ``base``: tweets_<id> (the raw rows), hashtags_<id> (top n) and hashtag_pairs_<id> (top n)."""

    def work(batch: DataFrame, batch_id: int) -> None:
        if archive:
            batch.write.mode("overwrite").parquet(batch_path(base, "tweets", batch_id))
        tags = hashtags_of(batch, text)
        top(hashtag_counts(tags), n, "cnt", "token").write.mode("overwrite").parquet(batch_path(base, "hashtags", batch_id))
        top(hashtag_pairs(tags), n, "cnt", "pair").write.mode("overwrite").parquet(batch_path(base, "hashtag_pairs", batch_id))

    on_batches(stream, work, f"{base}/_checkpoint", **how)


def merged_windows(stream: DataFrame, base: str, keys: list[str]) -> DataFrame:
    """The rows of a windowed count after all that is available now: every batch writes the windows it changed into its own folder below ``base`` (again
    after a failure), and the last batch that has a window holds its count. In update mode the state of windows behind the watermark is given up."""
    spark = stream.sparkSession
    schema = stream.schema

    def work(changed: DataFrame, batch_id: int) -> None:
        changed.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(batch_path(f"{base}/counts", "batch", batch_id))

    w = stream.writeStream.outputMode("update").foreachBatch(work).option("checkpointLocation", f"{base}/checkpoint")
    w.trigger(availableNow=True).start().awaitTermination()
    all_batches = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
    spark.createDataFrame([], all_batches).write.mode("overwrite").parquet(f"{base}/counts/none")
    seen = spark.read.option("recursiveFileLookup", True).schema(all_batches).parquet(f"{base}/counts")
    rest = [c for c in schema.names if c not in keys]
    return seen.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest]).select(*schema.names)


def window_counts(stream: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """window_start, kind, cnt: tumbling event-time windows with a watermark (time is cast to a timestamp, as watermarks need).

    Rows that arrive more than ``late`` behind the greatest time of the batches before may be left out, and their windows' state is given up.
    """
    t = stream.select(F.col(time).cast("timestamp").alias("_t"), F.col(kind).alias(kind)).withWatermark("_t", late)
    return t.groupBy(F.window("_t", width).alias("w"), kind).agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("window_start"), kind, "cnt")
