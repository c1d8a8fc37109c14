"""Spark results against DuckDB's on the same tables."""

from collections import Counter
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compare(spark, folder, query, sql):
    con = duckdb.connect()
    con.execute("SET threads = 2; SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    got = query(spark, folder)
    names = sorted(got.columns)
    rows = Counter(repr(tuple(plain(r[c]) for c in names)) for r in got.collect())
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert rows == Counter(repr(tuple(plain(r[k]) for k in order)) for r in found.fetchall())
