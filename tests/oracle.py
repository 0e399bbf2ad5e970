"""Compares registered queries with their SQL on one folder of tables."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(row: tuple) -> tuple:
    return tuple(
        round(v, 9) if isinstance(v, float) and math.isfinite(v) else v for v in row
    )


def compare(spark, con, name: str, run, sql: str, folder: str) -> dict:
    """Rows, column names and values of both engines, order aside."""
    began = time.time()
    df = run(spark, folder)
    columns = sorted(df.columns)
    ours = sorted((normal(tuple(r)) for r in df.select(*columns).collect()), key=repr)
    seconds = time.time() - began
    quoted = ", ".join(f'"{c}"' for c in columns)
    theirs_columns = sorted(con.sql(sql).columns)
    result = {"name": name, "rows": len(ours), "seconds": round(seconds, 2), "ok": False, "why": ""}
    if theirs_columns != columns:
        result["why"] = f"columns {columns} against {theirs_columns}"
        return result
    theirs = sorted((normal(tuple(r)) for r in con.sql(f"SELECT {quoted} FROM ({sql}) q").fetchall()), key=repr)
    if len(ours) != len(theirs):
        result["why"] = f"{len(ours)} rows against {len(theirs)}"
        return result
    for a, b in zip(ours, theirs):
        if a != b:
            result["why"] = f"{str(a)[:300]} against {str(b)[:300]}"
            return result
    result["ok"] = True
    return result
