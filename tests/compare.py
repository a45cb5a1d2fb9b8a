"""Spark queries against DuckDB on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def same_rows(df, sql: str, sf_dir: str) -> tuple[list, list]:
    """Sorted rows of both with columns by name; raises where names differ."""
    got = connect(sf_dir).sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(got.columns), (columns, got.columns)
    order = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=key)
    return ours, theirs
