"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def _value(x):
    return round(x, 9) if isinstance(x, float) and math.isfinite(x) else x


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir: str, run, sql: str) -> str:
    """Empty if they agree, else what differs."""
    df = run(spark, sf_dir)
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    theirs = canonical(*sql_rows(sf_dir, sql))
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if mine[1] != theirs[1]:
        a, b = set(map(repr, mine[1])), set(map(repr, theirs[1]))
        return f"{len(mine[1])} and {len(theirs[1])} rows; only here {sorted(a - b)[:3]}; only in SQL {sorted(b - a)[:3]}"
    return ""
