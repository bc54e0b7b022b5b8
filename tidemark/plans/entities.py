"""Staging: explicitly typed projections of the Silver entities, and where the test tables supply them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import label_key, ref_key
from tidemark.operators.feature_table import latest_per_key
from tidemark.sources.tables import table

_AUDIT = "processed_at timestamp, processing_date date"
#: Columns and types of the eight staged entities, in order.
STAGING = {
    "customers": f"customer_id string, first_name string, last_name string, email string, phone_number string, document_number string, birth_date date, is_active boolean, created_at timestamp, updated_at timestamp, deleted_at timestamp, {_AUDIT}",
    "orders": f"order_id string, order_number string, customer_id string, status string, total_amount decimal(19,4), shipping_amount decimal(19,4), created_at timestamp, updated_at timestamp, {_AUDIT}",
    "order_items": f"order_item_id string, order_id string, product_id string, quantity int, unit_price decimal(19,4), total_price decimal(19,4), created_at timestamp, {_AUDIT}",
    "products": f"product_id string, seller_id string, category_id string, sku string, name string, description string, brand string, price decimal(19,4), weight decimal(10,3), height decimal(10,2), width decimal(10,2), length decimal(10,2), status string, is_active boolean, created_at timestamp, updated_at timestamp, deleted_at timestamp, {_AUDIT}",
    "payments": f"payment_id string, order_id string, payment_method_id string, transaction_code string, amount decimal(19,4), status string, authorized_at timestamp, paid_at timestamp, created_at timestamp, updated_at timestamp, {_AUDIT}",
    "sellers": f"seller_id string, company_name string, trade_name string, document_number string, email string, phone_number string, is_active boolean, created_at timestamp, updated_at timestamp, deleted_at timestamp, {_AUDIT}",
    "categories": f"category_id string, parent_category_id string, name string, description string, is_active boolean, created_at timestamp, updated_at timestamp, {_AUDIT}",
    "order_status_history": f"history_id string, order_id string, previous_status string, current_status string, changed_at timestamp, {_AUDIT}",
}


def columns(entity: str) -> list[tuple[str, str]]:
    """(name, type) of a staged entity."""
    return [tuple(c.strip().split(" ", 1)) for c in STAGING[entity].replace(", ", ";").replace("(19,4)", "(19~4)").split(";")]


def stage(df: DataFrame, entity: str) -> DataFrame:
    """Cast every declared column; what the source lacks is null, what is not declared is dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(n) if n in have else F.lit(None)).cast(t.replace("~", ",")).alias(n) for n, t in columns(entity)])


# --- The star-schema test tables as entities ---------------------------------------


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def classic(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Customers, orders, lines, parts, suppliers and events as the eight entities.

    Payments are derived from orders that are not open, so that some orders
    have none; the status history is the events, one step per event.
    """
    t = lambda n: table(spark, d, n)
    orders = t("orders")
    history = t("events").select(_text("event_id").alias("history_id"), _text("user_id").alias("order_id"), F.upper("event_type").alias("current_status"), F.col("ts").alias("changed_at"))
    raw = {
        "customers": t("customer").select(_text("c_custkey").alias("customer_id"), F.col("c_name").alias("first_name"), F.col("c_mktsegment").alias("last_name")),
        "orders": orders.select(_text("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("order_number"), _text("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total_amount"), F.col("o_orderdate").alias("created_at")),
        "order_items": t("lineitem").select(F.concat_ws("-", _text("l_orderkey"), _text("l_linenumber")).alias("order_item_id"), _text("l_orderkey").alias("order_id"), _text("l_partkey").alias("product_id"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice").cast("decimal(19,4)") / F.col("l_quantity").cast("decimal(19,4)")).alias("unit_price"), F.col("l_extendedprice").alias("total_price"), F.col("l_shipdate").alias("created_at")),
        "products": t("part").select(_text("p_partkey").alias("product_id"), (F.col("p_partkey") % 100).cast("string").alias("seller_id"), F.col("p_type").alias("category_id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price")),
        "sellers": t("supplier").select(_text("s_suppkey").alias("seller_id"), F.col("s_name").alias("company_name"), (F.col("s_acctbal") > 0).alias("is_active")),
        "categories": t("part").select(F.col("p_type").alias("category_id"), F.lower("p_type").alias("name")).distinct(),
        "payments": orders.where(F.col("o_orderstatus") != "O").select(F.concat(F.lit("pay-"), _text("o_orderkey")).alias("payment_id"), _text("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("amount"), F.lit("PAID").alias("status"), F.col("o_orderdate").alias("paid_at")),
        "order_status_history": history,
    }
    return {n: stage(df, n) for n, df in raw.items()}


# --- The marketplace test tables as entities ----------------------------------------


def _latest(df: DataFrame, entity: str, key: str, order: list[str], refs: tuple[str, ...] = (), labels: tuple[str, ...] = ()) -> DataFrame:
    """Standardized rows of an entity: tidy keys and labels, the last row of each key."""
    have = set(df.columns)
    tidy = {n: ref_key(n) if n in refs else label_key(n) if n in labels else F.col(n) for n, _ in columns(entity) if n in have and n != key}
    return stage(latest_per_key(df.where(ref_key(key).isNotNull()), {key: ref_key(key)}, [F.col(o) for o in order], tidy), entity)


def marketplace(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The marketplace tables as entities, each reduced to its current rows.

    Payments keep the last row per order (the source allows one per order).
    Sellers are those the products name. The status history is the sequence of
    distinct states an order was loaded in.
    """
    t = lambda n: table(spark, d, n)
    products = _latest(t("products"), "products", "product_id", ["updated_at", "processed_at"], ("seller_id", "category_id"), ("status",))
    payments = _latest(t("payments").where(ref_key("order_id").isNotNull()), "payments", "order_id", ["updated_at", "processed_at", "payment_id"], (), ("status",))
    states = t("marketplace_orders").select(ref_key("order_id").alias("order_id"), label_key("status").alias("current_status"), F.col("updated_at").alias("changed_at")).distinct()
    return {
        "orders": _latest(t("marketplace_orders"), "orders", "order_id", ["updated_at", "processed_at"], ("customer_id",), ("status",)),
        "order_items": _latest(t("order_items"), "order_items", "order_item_id", ["processed_at"], ("order_id", "product_id")),
        "products": products,
        "payments": payments,
        "sellers": stage(products.select("seller_id", F.concat(F.lit("Seller "), F.left("seller_id", F.lit(8))).alias("company_name")).where(F.col("seller_id").isNotNull()).distinct(), "sellers"),
        "categories": _latest(t("categories"), "categories", "category_id", ["updated_at", "processed_at"], ("parent_category_id",)),
        "order_status_history": stage(states.withColumn("history_id", F.concat_ws("|", "order_id", F.unix_micros("changed_at").cast("string"), "current_status")), "order_status_history"),
    }
