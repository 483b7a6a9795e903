"""Session helpers: table loading, shared checkpoint folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes of a side that may be broadcast; beyond it every caller falls back to a shuffled join.
BROADCAST_BYTES = 64 << 20
#: Rows of one key beyond which a shuffled join treats the key as hot.
HOT_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of so few splits that most cores would idle is dealt out to all of them; larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() <= cores else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder named by ``spark.checkpoint.dir``; where it is unset, one machine gets a local folder (removed at exit) and a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="quillspan-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computes ``df`` once and survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bytes_of(df: DataFrame) -> int:
    """Bytes of the rows of ``df`` (cheap to read, e.g. a checkpoint), with 16 of overhead a row and a column; nested columns count as JSON."""

    def width(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0))
        return F.lit(8)

    row = sum((width(f) for f in df.schema.fields), F.lit(0)) + 16 * (1 + len(df.columns))
    return int(df.agg(F.sum(row.cast("bigint"))).first()[0] or 0)


def small_or_plain(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast only if ``df`` (cheap to read, e.g. a checkpoint) is proven to hold at most ``max_bytes``."""
    return F.broadcast(df) if bytes_of(df) <= max_bytes else df


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str | list[str], count: str, max_bytes: int = BROADCAST_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``rows`` with one row per key (of one or several columns), whose column ``count`` holds the key's number of rows (cheap to read, e.g. a checkpoint).

    Proven small, ``per_key`` is broadcast. Otherwise only its hot keys are (at most one per ``hot_rows`` rows, and their size is checked too), so that
    no task of the shuffled join for the rest meets more than ``hot_rows`` rows of a key.
    """
    if bytes_of(per_key) <= max_bytes:
        return rows.join(F.broadcast(per_key), key)
    keys = [key] if isinstance(key, str) else key
    hot = small_or_plain(per_key.where(F.col(count) > hot_rows), max_bytes)
    cold = rows.join(small_or_plain(per_key.where(F.col(count) > hot_rows).select(*keys), max_bytes), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cold.join(per_key.where(F.col(count) <= hot_rows), keys))


def micros(col) -> F.Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(F.col(col).cast("timestamp") if isinstance(col, str) else col.cast("timestamp"))


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per context, for clusters on which it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, "_quillspan_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quillspan-")) / "quillspan.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._quillspan_shipped = True
