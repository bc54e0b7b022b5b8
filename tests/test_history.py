import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history

T0 = dt.datetime(2026, 1, 1)


def brute(rows):
    by, gone = {}, {}
    for k, at, loaded, _, v, d in rows:
        if k is None:
            continue
        if d is not None:
            gone[k] = min(gone.get(k, d), d)
        if at is not None:
            cur = by.setdefault(k, {}).get(at)
            key = (loaded is not None, loaded or T0, v is not None, v or 0)
            if cur is None or key > cur[0]:
                by[k][at] = (key, v)
    out = set()
    for k, steps in by.items():
        versions = []
        for at in sorted(steps):
            if not versions or versions[-1][1] != steps[at][1]:
                versions.append((at, steps[at][1]))
        for i, (at, v) in enumerate(versions):
            end = versions[i + 1][0] if i + 1 < len(versions) else gone.get(k)
            out.add((k, us(at), -1 if end is None else us(end), v))
    return out


def us(t):
    return int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def run(spark, rows, ranges):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "k string, at timestamp, loaded timestamp, snap string, v int, gone timestamp, us string, entity string")
    found = history.version_history(df, F.col("k"), F.col("at"), F.col("loaded"), F.col("snap"), {"v": F.col("v")}, F.col("gone"), ranges=ranges)
    got = [tuple(r) for r in found.select("entity", "valid_from_us", "valid_to_us", "v").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("ranges", [1, 3, 11])
def test_random_snapshots_with_a_hot_entity(spark, ranges):
    rnd = random.Random(7)
    rows = []
    for i in range(240):
        k = "hot" if i % 3 else f"k{rnd.randrange(6)}"
        at = T0 + dt.timedelta(hours=rnd.randrange(120))
        rows.append((k, at, T0 + dt.timedelta(days=rnd.randrange(40)), f"s{rnd.randrange(5)}", rnd.choice([1, 2, None]), T0 + dt.timedelta(days=90) if k == "k1" else None))
    rows += rows[:20]
    assert run(spark, rows, ranges) == brute(rows)


def test_an_unchanging_hot_entity_is_one_version(spark):
    rows = [("hot", T0 + dt.timedelta(hours=i), T0, "s", 1, None) for i in range(200)]
    assert run(spark, rows, 8) == {("hot", us(T0), -1, 1)}


def test_empty_and_null_keys(spark):
    assert run(spark, [], 2) == set()
    assert run(spark, [(None, T0, T0, "s", 1, None), ("a", None, T0, "s", 1, None), ("b", T0, None, None, None, None)], 2) == {("b", us(T0), -1, None)}
