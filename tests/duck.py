"""Compares a Spark result with DuckDB's of the query's SQL twin."""

import glob
import os
from decimal import Decimal

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    if isinstance(v, list):
        return tuple(map(_plain, v))
    if isinstance(v, dict):
        return tuple(map(_plain, v.values()))
    return v


def rows(table):
    cols = sorted(table.column_names)
    return cols, sorted((tuple(map(_plain, r)) for r in zip(*[table.column(c).to_pylist() for c in cols])), key=repr)


def assert_same(df, con, sql):
    got_cols, got = rows(df.toArrow())
    want_cols, want = rows(con.sql(sql).to_arrow_table())
    assert got_cols == want_cols
    assert got == want
