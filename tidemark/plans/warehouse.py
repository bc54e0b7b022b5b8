"""Queries of the warehouse's own operators: Silver, staging, Gold, dashboards, quality, profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality, standardize, tiers, upsert
from tidemark.plans import entities, gold, models
from tidemark.session import scratch
from tidemark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- Silver ----------------------------------------------------------------------------


@query
def silver_trim_normalize(spark, d):
    """Untidy names and blanks made tidy."""
    raw = table(spark, d, "customer").select(F.col("c_custkey").alias("CustomerKey"), F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("Full Name"), F.col("c_mktsegment").alias("market.segment"), F.col("c_acctbal").alias("_AcctBal"))
    return standardize.trim_strings(standardize.normalize_names(raw))


@query
def silver_dedup_exact(spark, d):
    """Whole-row duplicates go."""
    return standardize.drop_repeats(table(spark, d, "order_items").drop("processed_at", "processing_date"))


@query
def silver_dedup_latest(spark, d):
    """The last loaded row of each category."""
    rows = table(spark, d, "categories").select("category_id", "parent_category_id", "name", "updated_at", "processed_at")
    return standardize.latest_by_key(rows, ["category_id"], "updated_at", ["processed_at"])


@query
def silver_standardize(spark, d):
    """The composite: names, blanks, duplicates, latest per key; audit columns checked and left out."""
    rows = table(spark, d, "shipments").select(F.col("shipment_id").alias("ShipmentId"), F.col("status").alias("Status"), F.unix_micros("updated_at").alias("_cdc_ts_ms"))
    done = standardize.standardize(rows, ["shipment_id"])
    return done.where(F.col("processed_at").isNotNull() & F.col("processing_date").isNotNull()).drop("processed_at", "processing_date")


# --- Staging, Gold, dashboards ---------------------------------------------------------------

_HIDDEN = ("processed_at", "processing_date")


def _staged(entity: str) -> Query:
    return lambda spark, d: entities.classic(spark, d)[entity].drop(*_HIDDEN)


def _market_staged(entity: str) -> Query:
    return lambda spark, d: entities.marketplace(spark, d)[entity].drop(*_HIDDEN)


def _gold(name: str, source: Callable) -> Query:
    return lambda spark, d: models.build(name, source(spark, d))


QUERIES.update({f"stg_{e}": _staged(e) for e in entities.STAGING})
QUERIES.update({f"market_stg_{e}": _market_staged(e) for e in ("orders", "order_items", "products", "payments", "categories", "order_status_history")})
QUERIES.update({n: _gold(n, entities.classic) for n in models.MODELS})
QUERIES.update({f"market_{n}": _gold(n, entities.marketplace) for n in models.MODELS if n != "dim_customers"})


def _written(spark, d, *names: str):
    return gold.write_gold(spark, entities.marketplace(spark, d), scratch(spark, "gold"), names)


@query
def gold_fact_orders(spark, d):
    """The facts as read from the table written by year and month."""
    return _written(spark, d, "fact_orders")["fact_orders"]


@query
def gold_orders_of_a_month(spark, d):
    """One partition of the written facts: the others are not read."""
    facts = _written(spark, d, "fact_orders")["fact_orders"]
    return facts.where((F.col("order_year") == 2026) & (F.col("order_month") == 1)).select("order_id", "order_status", "total_amount")


@query
def gold_dashboards(spark, d):
    """Orders and revenue by status, on the view of the written facts."""
    gold.show_views(_written(spark, d, "fact_orders"))
    return spark.sql("SELECT order_status, count(*) AS total_orders, CAST(sum(total_amount) AS DECIMAL(38,4)) AS revenue FROM gold_fact_orders GROUP BY order_status")


@query
def order_value_tier(spark, d):
    """Three tiers of all orders by amount, without a global window."""
    orders = entities.classic(spark, d)["orders"].select("order_id", "total_amount")
    return tiers.ntile(orders, "total_amount", "order_id", 3, "order_value_tier")


# --- Quality and profiles ----------------------------------------------------------------------


@query
def dq_not_null(spark, d):
    return quality.not_null(table(spark, d, "payments"), "order_id").select("payment_id")


@query
def dq_unique(spark, d):
    return quality.unique(table(spark, d, "order_items"), "order_item_id")


@query
def dq_relationships(spark, d):
    """Items of the staged orders whose product is not in the catalogue."""
    e = entities.marketplace(spark, d)
    return quality.relationships(e["order_items"], "product_id", e["products"], "product_id").select("order_item_id", "product_id")


@query
def dq_accepted_values(spark, d):
    return quality.accepted_values(table(spark, d, "marketplace_orders"), "status", list(models.STATUS_PLACE))


@query
def dq_duration_non_negative(spark, d):
    steps = models.build("fact_order_status_transitions", entities.classic(spark, d))
    return quality.non_negative_duration(steps, "duration_in_previous_status_seconds").select("history_id")


@query
def dq_delivered_once(spark, d):
    """Orders with more than one purchase event (the classic tables' terminal step)."""
    history = entities.classic(spark, d)["order_status_history"]
    return quality.at_most_once(history, "order_id", F.col("current_status") == "PURCHASE")


@query
def dq_delivered_after_created(spark, d):
    facts = models.build("fact_orders", entities.marketplace(spark, d))
    return quality.not_before(facts, "delivered_at", "created_at").select("order_id")


@query
def dq_constraints(spark, d):
    return quality.broken_constraints(table(spark, d, "products"), "products")


@query
def dq_suite(spark, d):
    """A suite of tests and their failures in one result."""
    e = entities.marketplace(spark, d)
    tests = [quality.Test("orders.order_id not null", quality.not_null(e["orders"], "order_id")), quality.Test("orders.order_id unique", quality.unique(e["orders"], "order_id")), quality.Test("payments.order_id in orders", quality.relationships(e["payments"], "order_id", e["orders"], "order_id")), quality.Test("orders.customer_id not null", quality.not_null(e["orders"], "customer_id"))]
    return quality.run_suite(tests)


@query
def dq_declared(spark, d):
    """Every declared test of the facts: keys, references, accepted values."""
    e = entities.marketplace(spark, d)
    facts, steps = models.build("fact_orders", e), models.build("fact_order_status_transitions", e)
    items = models.build("int_order_items_enriched", e)
    known = {"fact_orders": facts, "transitions": steps, "items": items, "orders": e["orders"], "products": e["products"]}
    return quality.run_suite([quality.declared(known, *t) for t in quality.DECLARED])


def _lines_with_dates(spark, d):
    lines, orders = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return lines.join(orders, "l_orderkey")


@query
def dq_shipped_before_order(spark, d):
    """Lines shipped before their order's date: rows that a date-order test lists."""
    return quality.not_before(_lines_with_dates(spark, d), "l_shipdate", "o_orderdate").select("l_orderkey", "l_linenumber", "l_shipdate")


@query
def dq_negative_days(spark, d):
    """Days from order to shipping that are negative: rows that a duration test lists."""
    days = F.datediff("l_shipdate", "o_orderdate").cast("bigint")
    return quality.non_negative_duration(_lines_with_dates(spark, d).select("l_orderkey", "l_linenumber", days.alias("days")), "days")


@query
def active_products(spark, d):
    """Products that are active, of the last loaded rows."""
    return entities.marketplace(spark, d)["products"].where("is_active").select("product_id", "status")


@query
def preview(spark, d):
    """The first hundred orders by key: what a preview shows."""
    return table(spark, d, "orders").orderBy("o_orderkey").limit(100).select("o_orderkey", "o_orderstatus")


@query
def set_operations(spark, d):
    """Customers with orders and without, by set operations."""
    everyone, ordered = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return everyone.intersect(ordered).withColumn("has_orders", F.lit(True)).unionByName(everyone.exceptAll(ordered.distinct()).withColumn("has_orders", F.lit(False)))


@query
def profile_nulls(spark, d):
    return quality.profile_nulls(table(spark, d, "marketplace_orders"))


@query
def profile_duplicates(spark, d):
    rows = table(spark, d, "order_items").select("order_item_id", "order_id", "product_id", "quantity")
    return quality.profile_repeats(rows)


COUNTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query
def profile_row_counts(spark, d):
    return quality.row_counts({n: table(spark, d, n) for n in COUNTED})


# --- Operational writes ---------------------------------------------------------------------------


@query
def insert_absent(spark, d):
    """Customers that would be inserted beside those of the first nations."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    return upsert.insert_absent(rows.where(F.col("c_nationkey") < 5), rows, ["c_custkey"])


@query
def conditional_update(spark, d):
    """Open orders of the lowest priority closed."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return upsert.update_where(rows, (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "5-LOW"), {"o_orderstatus": F.lit("F")})[0]


@query
def status_candidates(spark, d):
    """The fifteen paid orders longest unchanged at a moment."""
    orders = entities.marketplace(spark, d)["orders"]
    due = upsert.due_candidates(orders, "PAID", "60 seconds", 15, F.to_timestamp(F.lit("2026-06-01 00:00:00")), "order_id")
    return due.select("order_id", "updated_at")


@query
def low_stock_priority(spark, d):
    """The part to restock first: small sizes before others, then by key."""
    parts = table(spark, d, "part").select("p_partkey", "p_size")
    return upsert.priority_pick(parts, F.col("p_size") < 5, F.col("p_partkey"), 5)
