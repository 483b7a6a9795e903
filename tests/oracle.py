"""Compares a query with its SQL on the smallest tables."""

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def same(spark, query, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = query(spark, SF)
    cols = sorted(got.columns)
    ours = Counter(tuple(plain(r[c]) for c in cols) for r in got.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert ours == theirs
