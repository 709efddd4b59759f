"""Runs a query in Spark and its SQL in DuckDB, and compares the rows without order."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return int(value) if isinstance(value, int) else str(value)


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty if both have the same columns and rows."""
    names = sorted(df.columns)
    spark_rows = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    out = connection(sf_dir).execute(sql)
    have = [c[0] for c in out.description]
    if sorted(have) != names:
        return f"columns {names} and {sorted(have)}"
    at = [have.index(c) for c in names]
    sql_rows = Counter(tuple(plain(r[i]) for i in at) for r in out.fetchall())
    if spark_rows == sql_rows:
        return "" if spark_rows else "no rows"
    return f"{sum(spark_rows.values())} and {sum(sql_rows.values())} rows; only Spark {list((spark_rows - sql_rows).items())[:3]}; only SQL {list((sql_rows - spark_rows).items())[:3]}"
