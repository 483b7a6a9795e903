"""Fixed-width weather records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Name, first byte, end (exclusive), type, divisor of each field; the code of a missing air temperature.
FIELDS = (
    ("year", 15, 19, "int", 1), ("month", 19, 21, "int", 1), ("day", 21, 23, "int", 1), ("hour", 23, 25, "int", 1),
    ("latitude", 28, 34, "double", 1000), ("longitude", 34, 41, "double", 1000), ("elevation", 46, 51, "int", 1),
    ("direction", 60, 63, "int", 1), ("speed", 65, 69, "double", 10), ("ceiling", 70, 75, "int", 1), ("distance", 78, 84, "int", 1),
    ("dew_point", 93, 98, "double", 10), ("label", 87, 92, "double", 10),
)
MISSING = "+9999"


def parse_records(raw: DataFrame, value: str, *keep: str) -> DataFrame:
    """keep and the 13 fields; records whose air temperature (label) is missing are dropped, fields that can't be read are null.

    A generator hands on the lines: no filter on a field can be pushed below it, where it would compute a derived line once more for every field that it names.
    """
    cut = lambda a, b: F.substring(F.col(value), a + 1, b - a)
    cols = [(cut(a, b).try_cast(kind) / by if by > 1 else cut(a, b).try_cast(kind)).alias(n) for n, a, b, kind, by in FIELDS]
    return raw.select(*[k for k in keep if k != value], F.explode(F.array(value)).alias(value)).where(cut(87, 92) != MISSING).select(*keep, *cols)


def split_years(df: DataFrame, first: int = 1949, last: int = 2021) -> tuple[DataFrame, DataFrame]:
    """Rows of the years from first to last, and all others."""
    inside = F.coalesce(F.col("year").between(first, last), F.lit(False))
    return df.where(inside), df.where(~inside)
