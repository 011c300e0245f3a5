"""Compare a query with its SQL counterpart, value by value."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf_dir, name)}.parquet'")
    return con


def _value(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return ""
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, pd.Timestamp):
        return v.tz_localize(None).isoformat()
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return str(v)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(map(_value, r)) for r in ordered.astype(object).itertuples(index=False))


def difference(actual: pd.DataFrame, expected: pd.DataFrame) -> str:
    """Empty when both hold the same rows, else what differs first."""
    if sorted(actual.columns) != sorted(expected.columns):
        return f"columns {sorted(actual.columns)} against {sorted(expected.columns)}"
    a, e = rows(actual), rows(expected)
    if a == e:
        return ""
    only_a, only_e = sorted(set(a) - set(e))[:3], sorted(set(e) - set(a))[:3]
    return f"{len(a)} rows against {len(e)}; only here: {only_a}; only there: {only_e}"
