"""Run a query on Spark and its oracle on DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else a short description."""
    relation = con.sql(sql)
    theirs_columns = list(relation.columns)
    if sorted(spark_df.columns) != sorted(theirs_columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(theirs_columns)}"
    mine = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    theirs = rows_of(theirs_columns, relation.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} rows vs {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{sorted(spark_df.columns)}\n  spark  {a}\n  oracle {b}"
    return None
