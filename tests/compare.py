"""Compares a registered query with its checking SQL, column by column and row by row."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) and abs(value) < 1e15 else float(f"{value:.9g}")
    if isinstance(value, int):
        return value
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, con) -> str | None:
    """None when equal, else a short description of the difference."""
    cursor = con.execute(sql)
    expected_names = [d[0] for d in cursor.description]
    expected = _rows(expected_names, cursor.fetchall())
    if sorted(df.columns) != sorted(expected_names):
        return f"columns {sorted(df.columns)} != {sorted(expected_names)}"
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    if actual == expected:
        return None
    a, b = set(actual), set(expected)
    only_a, only_b = sorted(a - b, key=repr)[:3], sorted(b - a, key=repr)[:3]
    return (
        f"{len(actual)} rows vs {len(expected)}; columns {sorted(df.columns)}\n"
        f"  only spark ({len(a - b)}): {only_a}\n  only sql ({len(b - a)}): {only_b}"
    )
