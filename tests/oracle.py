"""Compare a query with its SQL on one folder of tables."""

from __future__ import annotations

import os
from collections import Counter
from pathlib import Path

import duckdb

DATA = os.environ.get("TIDEMARK_DATA", "/root/testdata")


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(root).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None) is not None:
        return v.replace(tzinfo=None)
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return v


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, name: str, root: str) -> tuple[int, list, list]:
    """Number of rows, and up to five rows that only one side has."""
    import __spark_entry__ as e

    df = e.queries()[name](spark, root)
    ours = bag(df.columns, df.collect())
    con = connect(root)
    cur = con.execute(e.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns), (columns, df.columns)
    theirs = bag(columns, cur.fetchall())
    return sum(ours.values()), list((ours - theirs).items())[:5], list((theirs - ours).items())[:5]
