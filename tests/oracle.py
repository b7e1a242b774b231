"""Comparison of a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        assert not math.isnan(v), "a NaN equals nothing; give null on both sides"
        return f"{v:.9g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return bytes(v).hex() if isinstance(v, bytes | bytearray) else str(v)


def database(base: str):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{base}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def assert_same(df, c, sql: str) -> None:
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[k]) for k in columns) for r in df.collect())
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(k)]) for k in columns) for r in found.fetchall())
    assert rows == want
