"""Runs a query and its oracle over the same tables and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

DATA = os.environ.get("ORACLE_DATA", "/root/testdata")


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(cell(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, cell(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return tuple(sorted((k, cell(v)) for k, v in x.asDict().items()))
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def differences(spark, name: str, query, sql: str, sf: str) -> str:
    """Empty if both agree, else what differs."""
    df = query(spark, f"{DATA}/{sf}")
    got = df.collect()
    con = connection(sf)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"{name}: columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, got), rows(names, want)
    if len(a) != len(b):
        return f"{name}: {len(a)} rows and {len(b)}"
    odd = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{name}: {len(odd)} of {len(a)} rows, first {odd[0]}" if odd else ""
