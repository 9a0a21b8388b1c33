"""Compare a Spark result with DuckDB's, column by column and row by row."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return ("f", "nan") if math.isnan(v) else ("f", v + 0.0)
    if isinstance(v, decimal.Decimal):
        return ("d", v.normalize() + 0)
    if isinstance(v, (dt.datetime, dt.date)):
        return ("t", str(v))
    if isinstance(v, bool) or v is None:
        return ("b", v)
    return (type(v).__name__, v)


KIND = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def _kind(simple: str) -> str:
    return KIND.get(simple, simple.upper())


def compare(result, con, sql: str) -> list[str]:
    """Differences as text; empty when schema and rows agree."""
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    types = {d[0]: str(d[1]) for d in expected.description}
    problems = []
    if sorted(names) != sorted(result.columns):
        return [f"columns {sorted(result.columns)} != {sorted(names)}"]
    for name, simple in result.dtypes:
        if _kind(simple) != types[name].replace(" ", ""):
            problems.append(f"{name}: {simple} vs {types[name]}")
    order = sorted(names)
    want = sorted((tuple(_plain(v) for _, v in sorted(zip(names, r))) for r in expected.fetchall()), key=repr)
    got = sorted((tuple(_plain(r[c]) for c in order) for r in result.collect()), key=repr)
    if len(want) != len(got):
        problems.append(f"rows {len(got)} != {len(want)}")
    for g, w in zip(got, want):
        if g != w:
            diff = [(c, a[1], b[1]) for c, a, b in zip(order, g, w) if a != b]
            problems.append(f"{diff[:4]} in {g[:3]}")
            if len(problems) > 5:
                break
    return problems
