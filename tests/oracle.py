"""Runs a registered query and its SQL on the same files and compares the rows."""

from __future__ import annotations

import datetime
import math

import duckdb

from registered.views import BASE


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r)
    )


def compare(spark, con, sf_dir, name, fn, sql):
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = rows(df.columns, got), rows(columns, want)
    if a == b:
        return None
    only_a = [x for x in a if x not in set(b)][:2]
    only_b = [x for x in b if x not in set(a)][:2]
    return f"rows {len(a)} / {len(b)}; only spark {str(only_a)[:600]}; only sql {str(only_b)[:600]}"
