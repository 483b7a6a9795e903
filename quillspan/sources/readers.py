"""Readers of the file formats the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MOVIE_SCHEMA = "release_year int, title string, origin string, director string, cast_names string, genre string, wiki_page string, plot string"


def read_lines(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """value: one row per line of all files in the paths, which may hold globs and brace lists."""
    return spark.read.option("recursiveFileLookup", recursive).text(paths)


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Header and inferred types."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_csv_records(spark: SparkSession, path: str, schema: str | StructType, drop_malformed: bool = True) -> DataFrame:
    """Header, explicit schema, line breaks inside quotes; malformed rows are dropped, whatever columns are used later."""
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "DROPMALFORMED" if drop_malformed else "PERMISSIVE").schema(schema)
    rows = d.csv(path)
    # always true, but it needs every column: with pruned columns the parser would pass over errors in the others
    return rows.where(F.xxhash64(*rows.columns) >= F.lit(-(2**63)))


def read_tsv_counts(spark: SparkSession, path: str) -> DataFrame:
    """token, cnt of a tab-separated count file."""
    return spark.read.option("sep", "\t").schema("token string, cnt bigint").csv(path)


def read_whitespace_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Columns (as text) of a table whose cells are separated by blanks or tabs, however many; empty lines are left out, missing cells are null."""
    cells = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    return spark.read.text(path).where(F.col("value").rlike(r"\S")).select(*[F.get(cells, F.lit(k)).alias(c) for k, c in enumerate(columns)])


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """token: one word per line, blanks around it taken off, empty lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("token")).where("token <> ''").distinct()


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """feature_id, boroughcode, borough, geojson: the features of a GeoJSON FeatureCollection with these properties."""
    doc = spark.read.option("wholetext", True).text(path)
    schema = "struct<features array<struct<properties map<string,string>, geometry string>>>"
    f = doc.select(F.posexplode(F.from_json("value", schema)["features"]).alias("i", "f"))
    p = lambda *names: F.coalesce(*[F.col("f.properties")[n] for n in names])
    return f.select((F.col("i") + 1).cast("bigint").alias("feature_id"), p("boroughCode", "boroughcode").cast("int").alias("boroughcode"), p("borough").alias("borough"), F.col("f.geometry").alias("geojson"))


def sample_rows(df: DataFrame, fraction: float, seed: int = 1, key: str | None = None) -> DataFrame:
    """Bernoulli sample without replacement; by the hash of a key if given, so that the same rows come every time."""
    if key is None:
        return df.sample(False, fraction, seed)
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(fraction * 1_000_000))
