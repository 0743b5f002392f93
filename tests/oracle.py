"""Side-by-side check of a registered Spark query against its DuckDB SQL.

Mirrors the driver's gate: row count, column names, and an order-insensitive
comparison of the values (columns sorted by name).
"""

from __future__ import annotations

import math

import duckdb

from tessera.sources.tables import TABLES


def duck(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 9)
    if hasattr(v, "item"):
        v = v.item()
        return _norm(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, name: str, fn, sql: str, root: str, con=None):
    sdf = fn(spark, root)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    con = con or duck(root)
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}")
        return problems, len(s_rows), len(d_rows)
    if len(s_rows) != len(d_rows):
        problems.append(f"row count spark={len(s_rows)} duck={len(d_rows)}")
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    if a != b:
        sa, sb = set(a), set(b)
        only_s = list(sa - sb)[:3]
        only_d = list(sb - sa)[:3]
        problems.append(f"values differ; cols={sorted(s_cols)} only_spark={only_s} only_duck={only_d}")
    return problems, len(s_rows), len(d_rows)
