"""Runs a query in Spark and its SQL in DuckDB, and compares the rows, in any order."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

from folio.session import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):  # noqa: ANN001, ANN201
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else float(f"{v:.9g}"))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "is_integer") and not isinstance(v, int | float):
        return plain(float(v))
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return plain(float(v))
    return v


def differences(spark, query, sql: str, sf_dir: str) -> list[str]:  # noqa: ANN001
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    mine = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = connect(sf_dir).execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return [f"columns {cols} and {sorted(names)}"]
    at = [names.index(c) for c in cols]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    out = [f"only Spark {k} x{n}" for k, n in list((mine - theirs).items())[:3]]
    return out + [f"only SQL {k} x{n}" for k, n in list((theirs - mine).items())[:3]]
