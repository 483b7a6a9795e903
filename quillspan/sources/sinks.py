"""Writers: key-value text, output routed by kind, stripes, CSV and per-batch folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import is_number, is_word


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("sep", "\t").csv(path)


def write_by_kind(df: DataFrame, path: str, kind: str = "kind", mode: str = "errorifexists") -> None:
    """One folder per kind, without narrowing the write to as many tasks as there are kinds."""
    df.write.mode(mode).partitionBy(kind).option("sep", "\t").csv(path)


def write_words_and_numbers(counts: DataFrame, base: str, token: str = "token", mode: str = "errorifexists") -> None:
    """Two folders, ``words`` and ``numbers``, of one file each: for counts that are already limited. Other tokens are left out."""
    for name, keep in (("words", is_word), ("numbers", is_number)):
        counts.where(keep(F.col(token))).coalesce(1).write.mode(mode).option("sep", "\t").csv(f"{base}/{name}")


def write_sorted_counts(counts: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """token, cnt as files in descending order of the count, ties by token."""
    counts.orderBy(F.desc("cnt"), "token").write.mode(mode).option("sep", sep).option("header", True).csv(path)


def show_rows(df: DataFrame, n: int = 20) -> list[str]:
    """Prints the first ``n`` rows, tab-separated, and returns the lines."""
    lines = ["\t".join("null" if v is None else str(v) for v in r) for r in df.limit(n).collect()]
    print("\n".join(lines))
    return lines


def write_stripes(stripes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """token, tab, the map as JSON."""
    stripes.select("token", F.to_json("stripe").alias("stripe")).write.mode(mode).option("sep", "\t").option("quote", "").csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True, single_file: bool = False, mode: str = "errorifexists") -> None:
    """Arrays are joined by blanks, as CSV has none. ``single_file`` suits results that are already limited, such as top lists."""
    flat = df.select(*[F.concat_ws(" ", c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    (flat.coalesce(1) if single_file else flat).write.mode(mode).option("header", header).option("escape", '"').csv(path)


def batch_path(base: str, name: str, batch_id: int) -> str:
    return f"{base}/{name}_{batch_id}"
