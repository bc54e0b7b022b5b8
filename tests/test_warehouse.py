import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, quality, standardize, tiers, upsert
from tidemark.plans import entities, models


@pytest.mark.parametrize("raw, name", [("CustomerId", "customer_id"), ("First Name", "first_name"), ("_cdc_ts_ms", "cdc_ts_ms"), ("a.b-c/d", "a_b_c_d"), ("HTTPServer", "httpserver"), ("São Paulo", "so_paulo"), ("a  b", "a_b"), ("x__y_", "x_y")])
def test_names(raw, name):
    assert standardize.snake_name(raw) == name


def test_clashing_names_are_an_error(spark):
    with pytest.raises(ValueError, match="first_name"):
        standardize.normalize_names(spark.createDataFrame([(1, 2)], "FirstName int, first_name int"))
    with pytest.raises(ValueError, match="empty"):
        standardize.normalize_names(spark.createDataFrame([(1,)], "`__` int"))


def test_trim_leaves_tabs_and_other_types(spark):
    df = spark.createDataFrame([(1, "  alice  ", "\tx "), (2, None, "")], "id long, name string, `odd.name` string")
    assert [tuple(r) for r in standardize.trim_strings(df).orderBy("id").collect()] == [(1, "alice", "\tx"), (2, None, "")]


def test_standardize_with_and_without_key(spark):
    df = spark.createDataFrame([("p1", "old", 100), ("p1", "new", 200), ("p2", "only", 150), ("p2", "only", 150)], "ProductId string, Category string, _cdc_ts_ms long")
    plain = standardize.standardize(df)
    assert plain.count() == 3 and plain.columns == ["product_id", "category", "cdc_ts_ms", "processed_at", "processing_date"]
    assert plain.where("processed_at IS NULL OR processing_date IS NULL").count() == 0
    keyed = standardize.standardize(df, ["product_id"])
    assert {(r.product_id, r.category) for r in keyed.collect()} == {("p1", "new"), ("p2", "only")}
    by_name = standardize.standardize(df, ["product_id"], order="category")
    assert {(r.product_id, r.category) for r in by_name.collect()} == {("p1", "old"), ("p2", "only")}


@pytest.mark.parametrize("n, tiles", [(0, 3), (1, 3), (2, 3), (3, 3), (100, 3), (101, 4), (500, 7)])
def test_ntile_equals_the_window(spark, n, tiles):
    rnd = random.Random(n)
    df = spark.createDataFrame([(f"k{i:04d}", rnd.choice([None, Decimal(rnd.randrange(20))])) for i in range(n)], "key string, amount decimal(19,4)")
    got = {r.key: r.t for r in tiers.ntile(df, "amount", "key", tiles, "t").collect()}
    order = sorted(((r.amount is None, r.amount or 0, r.key) for r in df.collect()))
    size, extra = divmod(n, tiles)
    expected, at = {}, 0
    for t in range(tiles):
        for _, _, k in order[at : at + size + (t < extra)]:
            expected[k] = t + 1
        at += size + (t < extra)
    assert got == expected


def test_quality(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, None, -1), (None, "", 7)], "id int, s string, n int")
    assert quality.not_null(df, "id").count() == 1
    assert [tuple(r) for r in quality.unique(df, "id").collect()] == [(1, 2)]
    assert quality.relationships(df, "id", spark.createDataFrame([(2,)], "k int"), "k").count() == 2
    assert [tuple(r) for r in quality.accepted_values(df, "s", ["a"]).collect()] == [("", 1)]
    assert {r.column_name: (r.n_null, r.n_blank) for r in quality.profile_nulls(df).collect()} == {"id": (1, 0), "s": (1, 1), "n": (0, 0)}
    assert {r.constraint_name: r.n_rows for r in quality.broken_constraints(df, "x", {"n": "n >= 0", "s": "s IN ('a')"}).collect()} == {"n": 1, "s": 1}
    summary = quality.run_suite([quality.Test("good", df.limit(0)), quality.Test("bad", df)])
    assert {(r.test_name, r.n_failures, r.passed) for r in summary.collect()} == {("good", 0, True), ("bad", 3, False)}
    with pytest.raises(quality.QualityError, match=r"bad \(3\)"):
        quality.require(summary)
    with pytest.raises(quality.QualityError):
        quality.reconcile({"t": 3}, {"t": 2})
    quality.reconcile({"t": 3}, {"t": 3})


def test_upserts(spark):
    rows = spark.createDataFrame([("1", "PAID", dt.datetime(2026, 1, 1)), ("2", "PAID", dt.datetime(2026, 1, 2)), ("3", None, None)], "id string, status string, updated_at timestamp")
    assert upsert.insert_absent(rows.where("id = '1'"), rows.unionByName(rows), ["id"]).count() == 2
    after, changed = upsert.update_where(rows, F.col("status") == "PAID", {"status": F.lit("DONE")})
    assert sorted(map(str, [r.status for r in after.collect()])) == ["DONE", "DONE", "None"] and changed.count() == 2
    due = upsert.due_candidates(rows, "PAID", "60 seconds", 15, F.lit(dt.datetime(2026, 1, 2)))
    assert [r.id for r in due.collect()] == ["1"]
    assert [r.id for r in upsert.priority_pick(rows, F.col("status") == "PAID", F.col("id").desc(), 2).collect()] == ["2", "1"]


def test_models_build_only_what_they_need(spark):
    orders = entities.stage(spark.createDataFrame([("o1", "PAID", 10.0, dt.datetime(2026, 1, 1)), ("o2", "WEIRD", None, dt.datetime(2026, 2, 1))], "order_id string, status string, total_amount double, created_at timestamp"), "orders")
    empty = {e: entities.stage(spark.createDataFrame([], "x int"), e) for e in entities.STAGING}
    facts = models.build("fact_orders", {**empty, "orders": orders}).orderBy("order_id").collect()
    assert [(r.order_id, r.item_count, r.payment_id, r.delivered_at, r.order_value_tier, r.order_month) for r in facts] == [("o1", 0, None, None, 1, 1), ("o2", 0, None, None, 2, 2)]
    by = models.build("dash_orders_by_status", {**empty, "orders": orders}).collect()
    assert [(r.order_status, r.status_order) for r in by] == [("PAID", 2), ("WEIRD", None)]
    with pytest.raises(KeyError):
        models.build("fact_orders", {"orders": orders})


def test_transition_seconds_are_whole_and_start_at_creation(spark):
    t = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    empty = {e: entities.stage(spark.createDataFrame([], "x int"), e) for e in entities.STAGING}
    orders = entities.stage(spark.createDataFrame([("o", t(0))], "order_id string, created_at timestamp"), "orders")
    history = entities.stage(spark.createDataFrame([("h1", "o", t(0.9)), ("h2", "o", t(2.1)), ("h3", "p", t(9))], "history_id string, order_id string, changed_at timestamp"), "order_status_history")
    got = {r.history_id: r.duration_in_previous_status_seconds for r in models.build("fact_order_status_transitions", {**empty, "orders": orders, "order_status_history": history}).collect()}
    assert got == {"h1": 0, "h2": 1, "h3": None}


def test_counters_that_restart(spark):
    t = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([("a", t(0), 10.0), ("a", t(60), 15.0), ("a", t(120), 2.0), ("b", t(120), 7.0)], "s string, ts timestamp, v double")
    got = {r.s: r.increase for r in metrics.increase(df, ["s"], "ts", "v", F.lit(t(120)), 300).collect()}
    assert got == {"a": 7.0, "b": 0.0}
    q = metrics.histogram_quantile(metrics.histogram(df, ["s"], "v", [5.0, 10.0]), ["s"], 0.5).collect()
    assert {r.s: round(r.quantile, 3) for r in q} == {"a": 7.5, "b": 7.5}
