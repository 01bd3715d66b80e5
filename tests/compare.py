"""Run a registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(df, con, sql: str) -> str | None:
    """None if both give the same columns and exactly the same rows, else a description."""
    spark_columns, spark_rows = _sorted(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    duck_columns, duck_rows = _sorted([c[0] for c in cursor.description], cursor.fetchall())
    if spark_columns != duck_columns:
        return f"columns {spark_columns} != {duck_columns}"
    if not spark_rows:
        return "no rows"
    if spark_rows == duck_rows:
        return None
    left, right = set(spark_rows) - set(duck_rows), set(duck_rows) - set(spark_rows)
    return (
        f"{len(spark_rows)} vs {len(duck_rows)} rows; {len(left)} only in Spark, {len(right)} only in SQL; "
        f"{sorted(map(str, left))[:3]} / {sorted(map(str, right))[:3]}"
    )
