import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import feature_table

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "who string, kind string, ev string, amount long, at timestamp, entity string, salt string, best string"


def rows(spark, data):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in data], SCHEMA)


def stats(df, **kw):
    found = feature_table.entity_type_stats(df, F.col("who"), F.col("kind"), F.col("ev"), F.col("amount"), F.col("at"), **kw)
    return {(r.entity, r.kind): (r.n, r.total, r.last_us) for r in found.collect()}


def test_nulls_ties_and_clashing_columns(spark):
    us = int(T0.replace(tzinfo=dt.UTC).timestamp() * 1_000_000)
    got = stats(rows(spark, [("a", "x", "1", 5, T0), ("a", "x", "2", None, None), (None, "x", "3", 9, T0), ("a", None, "4", 1, T0), ("b", "y", None, None, None)]))
    assert got == {("a", "x"): (2, 5, us), ("a", None): (1, 1, us), ("b", "y"): (1, 0, None)}


def test_hot_entity_is_the_same_for_any_salts(spark):
    data = [("hot" if i % 3 else f"c{i}", "k", str(i), i, T0) for i in range(600)]
    assert stats(rows(spark, data), salts=1) == stats(rows(spark, data), salts=32)


def test_empty(spark):
    df = rows(spark, [])
    assert stats(df) == {}
    found = feature_table.entity_type_stats(df, F.col("who"), F.col("kind"), F.col("ev"), F.col("amount"), F.col("at"))
    assert feature_table.expand_types(found, ["x"]).count() == 0


def test_expand_has_every_type(spark):
    found = feature_table.entity_type_stats(rows(spark, [("a", "x", "1", 5, T0), ("b", "odd", "2", 1, T0)]), F.col("who"), F.col("kind"), F.col("ev"), F.col("amount"), F.col("at"))
    wide = {r["entity"]: r for r in feature_table.expand_types(found, ["X".lower(), "y"]).collect()}
    assert (wide["a"]["x_n"], wide["a"]["y_n"], wide["a"]["y_last_us"]) == (1, 0, None)
    assert (wide["b"]["events"], wide["b"]["x_n"]) == (1, 0)


def test_latest_per_key_breaks_ties_the_same_way(spark):
    df = spark.createDataFrame([("k", 1, "b"), ("k", 1, "a"), ("k", None, "z")], "k string, o int, v string")
    for d in (df, df.orderBy("v"), df.orderBy(F.desc("v"))):
        assert [tuple(r) for r in feature_table.latest_per_key(d, {"k": F.col("k")}, [F.col("o")], {"v": F.col("v")}).collect()] == [("k", "b")]


def test_three_hundred_types_are_all_laid_out(spark):
    rows = [(f"e{i % 7}", f"T{i % 300:03}", i, i % 11) for i in range(2100)]
    df = spark.createDataFrame([*rows, ("e0", None, 9999, 5)], "entity string, kind string, id int, amount int")
    stats = feature_table.entity_type_stats(df, F.col("entity"), F.col("kind"), F.col("id"), F.col("amount"), F.timestamp_seconds("id"))
    wide = feature_table.expand_types(stats)
    assert len(wide.columns) == 4 + 3 * 300
    got = {r.entity: r for r in wide.collect()}
    for e in got:
        own = [r for r in rows if r[0] == e]
        assert got[e].events == len(own) + (e == "e0") and got[e].other_n == (e == "e0")
        for k in ("T000", "T123", "T299"):
            assert (got[e][f"{k.lower()}_n"], got[e][f"{k.lower()}_total"]) == (len(x := [r for r in own if r[1] == k]), sum(r[3] for r in x))
