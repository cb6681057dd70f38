"""Compares a query's rows with those of its SQL."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    if isinstance(v, datetime.datetime):
        return v.date() if v.time() == datetime.time() else v
    return int(v) if isinstance(v, int) and not isinstance(v, bool) else v


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(df, con, sql: str) -> str:
    res = con.sql(sql)
    want, got = rows(res.columns, res.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(res.columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, not {sorted(res.columns)}"
    if len(want) != len(got):
        return f"{len(got)} rows, not {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    off = [b for b in bad if not all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-4 * max(1, abs(x))) for x, y in zip(*b))]
    return f"{len(off)} rows differ, such as {off[0]}" if off else ""
