"""Runs queries on Spark and DuckDB over the same tables and compares all values."""

from __future__ import annotations

import datetime
import decimal
import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return "\x00null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def kind(v):
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, (float, decimal.Decimal)):
        return "float"
    return type(v).__name__


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def types(columns, rows):
    found = {c: set() for c in columns}
    for r in rows:
        for c, v in zip(columns, r, strict=True):
            if v is not None:
                found[c].add(kind(v))
    return found


def compare(df, con, sql):
    """(problem or None, rows, spark seconds, duckdb seconds)"""
    t0 = time.time()
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    expected = cur.fetchall()
    t2 = time.time()
    got_c, got = table(df.columns, rows)
    exp_c, exp = table(columns, expected)
    problem = None
    if got_c != exp_c:
        problem = f"columns {got_c} != {exp_c}"
    elif len(got) != len(exp):
        problem = f"rows {len(got)} != {len(exp)}"
    elif got != exp:
        bad = [(g, e) for g, e in zip(got, exp, strict=True) if g != e]
        problem = f"{len(bad)} rows differ, first {str(bad[0])[:1500]}"
    else:
        a, b = types(df.columns, rows), types(columns, expected)
        diff = {c: (a[c], b[c]) for c in a if a[c] != b[c]}
        if diff:
            problem = f"types {diff}"
    return problem, len(rows), t1 - t0, t2 - t1
