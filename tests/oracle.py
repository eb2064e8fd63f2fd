"""Runs a query and its SQL side by side and compares columns and rows, whatever their order."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p}{'/**/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.10g}")
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if hasattr(x, "as_tuple"):
        return float(x)
    return x


def compare(df, con, sql: str) -> str:
    """'' if equal, else what differs."""
    cols = sorted(df.columns)
    mine = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = Counter(tuple(plain(r[k]) for k in at) for r in cur.fetchall())
    if mine == theirs:
        return ""
    return f"{sum(mine.values())} and {sum(theirs.values())} rows; only here: {list((mine - theirs).items())[:3]}; only there: {list((theirs - mine).items())[:3]}"
