import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import orphans

T0 = dt.datetime(2026, 1, 5)
DAY = dt.timedelta(days=1)


def build(spark, children, parents):
    c = spark.createDataFrame([(*r, "x", "y") for r in children], "row string, ref string, created timestamp, loaded timestamp, parent string, key string")
    p = spark.createDataFrame([(*r, "x") for r in parents], "pid string, loaded timestamp, gone timestamp, key string")
    return [orphans.Child(c, "lines", "row", "created", "loaded", {"ref": "things"})], [orphans.Parent(p, "things", "pid", "loaded", "gone")]


def test_kinds_of_problems(spark):
    children = [("1", " A ", T0, T0), ("2", "zz", T0, T0), ("3", "", T0, T0), ("4", None, T0, T0), ("5", "late", T0, T0), ("6", "dead", T0, T0), ("7", "dead", T0 - 9 * DAY, T0), ("8", "a", T0, None), ("2", "ZZ", T0, T0 + DAY), ("9", "late", T0, T0 + 9 * DAY)]
    parents = [("a", T0, None), ("A ", T0 + DAY, None), ("late", T0 + DAY, None), ("dead", T0, None), ("dead", T0, T0 - DAY), (None, T0, T0), ("", T0, T0)]
    c, p = build(spark, children, parents)
    got = {(r.row_id, r.problem) for r in orphans.broken_references(c, p).collect()}
    assert got == {("2", "missing"), ("5", "late"), ("6", "deleted")}
    counts = {(r.problem, r.created_month, r.n) for r in orphans.broken_reference_counts(c, p).collect()}
    assert counts == {("missing", "2026-01", 1), ("late", "2026-01", 1), ("deleted", "2026-01", 1)}


def test_hot_key_without_parent(spark):
    c, p = build(spark, [(str(i), "hot", T0, T0) for i in range(300)], [("a", T0, None)])
    assert orphans.broken_references(c, p).count() == 300
    group = [r for r in orphans.reference_groups(orphans.child_references(c), p).collect() if not r.is_parent]
    assert [(r.key, r.n_refs) for r in group] == [("hot", 300)]


def test_empty_tables(spark):
    c, p = build(spark, [], [])
    assert orphans.broken_references(c, p).count() == 0
    c, _ = build(spark, [("1", "a", T0, T0)], [])
    assert [r.problem for r in orphans.broken_references(c, p).collect()] == ["missing"]
    _, p = build(spark, [], [("a", T0, None)])
    assert orphans.broken_references(build(spark, [], [])[0], p).where(F.lit(True)).count() == 0
