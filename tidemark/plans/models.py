"""Gold models and dashboard queries as a graph of named, lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.tiers import ntile


@dataclass(frozen=True)
class Model:
    """``build`` gets the DataFrames named in ``needs``."""

    name: str
    needs: tuple[str, ...]
    build: Callable[..., DataFrame]


_MODELS: dict[str, Model] = {}


def model(*needs: str) -> Callable:
    def register(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _MODELS[fn.__name__] = Model(fn.__name__, needs, fn)
        return fn

    return register


def build(target: str, sources: Mapping[str, DataFrame], models: Mapping[str, Model] | None = None) -> DataFrame:
    """A model on given sources; only what it needs is built, each once. Nothing is run but the borders of the tiers of ``fact_orders``."""
    known = _MODELS if models is None else models
    graph, todo = {}, [target]
    while todo:
        name = todo.pop()
        if name in graph or name in sources:
            continue
        if name not in known:
            raise KeyError(f"no source or model {name!r}")
        graph[name] = known[name].needs
        todo += known[name].needs
    done = dict(sources)
    for name in TopologicalSorter(graph).static_order():
        if name not in done:
            done[name] = known[name].build(*[done[n] for n in known[name].needs])
    return done[target]


@model("customers")
def dim_customers(customers: DataFrame) -> DataFrame:
    return customers.drop("processed_at", "processing_date")


@model("products", "sellers", "categories")
def dim_products(products: DataFrame, sellers: DataFrame, categories: DataFrame) -> DataFrame:
    """A product with its seller and category, one row per product whatever is missing."""
    s = sellers.select("seller_id", F.col("company_name").alias("seller_name"), F.col("is_active").alias("seller_is_active"))
    c = categories.select("category_id", F.col("name").alias("category_name"))
    renamed = products.drop("processed_at", "processing_date").withColumnsRenamed({"name": "product_name", "status": "product_status"})
    return renamed.join(s, "seller_id", "left").join(c, "category_id", "left")


@model("order_items", "orders", "products", "sellers", "categories")
def int_order_items_enriched(items: DataFrame, orders: DataFrame, products: DataFrame, sellers: DataFrame, categories: DataFrame) -> DataFrame:
    """One row per order item with what is known of its order, product, seller and category."""
    i = items.select("order_item_id", "order_id", "product_id", "quantity", "unit_price", "total_price", F.col("created_at").alias("order_item_created_at"))
    o = orders.select("order_id", "order_number", F.col("status").alias("order_status"), "customer_id")
    # The small dimensions meet products first: the facts are joined once, on product_id.
    s = sellers.select("seller_id", F.col("company_name").alias("seller_name"))
    c = categories.select("category_id", F.col("name").alias("category_name"))
    p = products.select("product_id", F.col("name").alias("product_name"), F.col("sku").alias("product_sku"), F.col("price").alias("product_price"), "category_id", "seller_id").join(s, "seller_id", "left").join(c, "category_id", "left")
    return i.join(o, "order_id", "left").join(p, "product_id", "left")


@model("orders", "order_items", "payments", "order_status_history")
def fact_orders(orders: DataFrame, items: DataFrame, payments: DataFrame, history: DataFrame) -> DataFrame:
    """One row per order with its tier by amount."""
    tiered = ntile(orders, "total_amount", "order_id", 3, "order_value_tier")
    return fact_orders_untiered(tiered, items, payments, history)


@model("orders", "order_items", "payments", "order_status_history")
def fact_orders_untiered(orders: DataFrame, items: DataFrame, payments: DataFrame, history: DataFrame) -> DataFrame:
    """One row per order; lines and deliveries are aggregated before they are joined. What needs no tier builds on this one."""
    lines = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("item_count"), F.sum("quantity").alias("total_quantity"))
    delivered = history.where(F.col("current_status") == "DELIVERED").groupBy("order_id").agg(F.min("changed_at").alias("delivered_at"))
    paid = payments.select("order_id", "payment_id", F.col("status").alias("payment_status"), "payment_method_id", "paid_at")
    own = orders.drop("processed_at", "processing_date").withColumnRenamed("status", "order_status")
    joined = own.join(lines, "order_id", "left").join(paid, "order_id", "left").join(delivered, "order_id", "left")
    none = F.lit(0).cast("bigint")
    return joined.withColumns({"item_count": F.coalesce("item_count", none), "total_quantity": F.coalesce("total_quantity", none), "order_year": F.year("created_at").cast("bigint"), "order_month": F.month("created_at").cast("bigint")})


@model("order_status_history", "orders")
def fact_order_status_transitions(history: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per step with the whole seconds spent in the status before; the first counts from the order's creation."""
    steps = Window.partitionBy("order_id").orderBy("changed_at", "history_id")
    h = history.select("history_id", "order_id", "previous_status", "current_status", "changed_at", F.lag("changed_at").over(steps).alias("prior"))
    o = orders.select("order_id", "created_at")
    seconds = F.timestamp_diff("SECOND", F.coalesce("prior", "created_at"), F.col("changed_at"))
    return h.join(o, "order_id", "left").select("history_id", "order_id", "previous_status", "current_status", "changed_at", seconds.cast("bigint").alias("duration_in_previous_status_seconds"))


# --- Dashboards ----------------------------------------------------------------------

#: The order statuses and their place in a chart.
STATUS_PLACE = {"PENDING": 1, "PAID": 2, "PROCESSING": 3, "SHIPPED": 4, "DELIVERED": 5, "CANCELLED": 6}


@model("fact_orders_untiered")
def dash_total_orders(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count(F.lit(1)).alias("total_orders"))


@model("fact_orders_untiered")
def dash_orders_by_status(facts: DataFrame) -> DataFrame:
    place = F.lit(None).cast("int")
    for status, n in STATUS_PLACE.items():
        place = F.when(F.col("order_status") == status, n).otherwise(place)
    return facts.groupBy("order_status").agg(F.count(F.lit(1)).alias("total_orders")).withColumn("status_order", place).orderBy(F.col("status_order").asc_nulls_last(), "order_status")


@model("int_order_items_enriched")
def dash_top_products(items: DataFrame) -> DataFrame:
    revenue = items.groupBy("product_id", "product_name").agg(F.sum("total_price").cast("decimal(38,4)").alias("revenue"), F.count(F.lit(1)).alias("line_items"))
    return revenue.orderBy(F.col("revenue").desc_nulls_last(), "product_id").limit(10)


@model("int_order_items_enriched")
def dash_top_sellers(items: DataFrame) -> DataFrame:
    sold = items.groupBy("seller_id", "seller_name").agg(F.count_distinct("order_id").alias("total_orders"))
    return sold.orderBy(F.col("total_orders").desc(), F.col("seller_id").asc_nulls_last()).limit(10)


@model("fact_orders_untiered")
def dash_average_order_value(facts: DataFrame) -> DataFrame:
    return facts.agg(F.avg("total_amount").cast("decimal(19,4)").alias("average_order_value"))


# --- Reported indicators ---------------------------------------------------------------


@model("fact_orders_untiered")
def kpi_status_rate(facts: DataFrame) -> DataFrame:
    """Share of cancelled orders and mean hours to delivery."""
    hours = F.timestamp_diff("SECOND", F.col("created_at"), F.col("delivered_at")) / 3600
    return facts.agg(F.avg((F.col("order_status") == "CANCELLED").cast("double")).alias("cancel_rate"), F.avg(hours).alias("mean_delivery_hours"))


@model("fact_order_status_transitions")
def kpi_time_in_status(steps: DataFrame) -> DataFrame:
    """Mean seconds before each status was reached."""
    return steps.groupBy("current_status").agg(F.avg("duration_in_previous_status_seconds").alias("mean_seconds"), F.count(F.lit(1)).alias("steps"))


MODELS = dict(_MODELS)
