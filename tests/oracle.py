"""Compares registered queries with their SQL on the same tables."""

from __future__ import annotations

import math

import duckdb
import pyarrow.dataset as ds

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.register(t, ds.dataset(f"{sf_dir}/{t}.parquet").to_table())
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def differences(spark, name, f, sql, sf_dir, con):
    """None if equal, else what differs."""
    got = f(spark, sf_dir)
    cols, mine = rows_of(got.columns, [tuple(r) for r in got.collect()])
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    theirs_cols, theirs = rows_of(names, result.fetchall())
    if cols != theirs_cols:
        return f"{name}: columns {cols} and {theirs_cols}"
    if len(mine) != len(theirs):
        return f"{name}: {len(mine)} and {len(theirs)} rows"
    for a, b in zip(mine, theirs, strict=True):
        if a != b:
            return f"{name}: {a} and {b}"
    return None
