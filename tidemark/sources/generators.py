"""Seeded test rows with the distributions of the source's simulator, made in the JVM."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weights of statuses and ratings.
PAYMENT_WEIGHTS = {"PAID": 75, "AUTHORIZED": 10, "PENDING": 7, "FAILED": 5, "CANCELLED": 2, "REFUNDED": 1}
SHIPMENT_WEIGHTS = {"DELIVERED": 70, "IN_TRANSIT": 20, "SHIPPED": 7, "CREATED": 2, "RETURNED": 1}
RATING_WEIGHTS = {5: 65, 4: 20, 3: 8, 2: 4, 1: 3}


def uniform(seed: int, *key: Column | str) -> Column:
    """A number in [0, 1) from a seed and the row's key: the same on every run and partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(2**52)).cast("double") / float(2**52)


def weighted(u: Column, weights: Mapping) -> Column:
    """A value drawn by weights from a uniform number."""
    total, at, out = sum(weights.values()), 0.0, None
    for value, w in weights.items():
        at += w / total
        out = F.when(u < at, F.lit(value)) if out is None else out.when(u < at, F.lit(value))
    return out.otherwise(F.lit(list(weights)[-1]))


def _money(u: Column, low: float, high: float) -> Column:
    return (F.lit(low) + u * (high - low)).cast("decimal(19,4)")


def products(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    u = lambda i: uniform(seed + i, "id")
    return spark.range(n).select(F.col("id").cast("string").alias("product_id"), F.concat(F.lit("Brand "), F.floor(u(1) * 10)).alias("brand"), F.concat(F.lit("Product "), F.floor(u(2) * 10)).alias("name"), _money(u(3), 50, 15000).alias("price"), (0.1 + u(4) * 24.9).cast("decimal(10,3)").alias("weight"), *[(2 + u(5 + i) * 118).cast("decimal(10,2)").alias(c) for i, c in enumerate(("height", "width", "length"))])


def orders(spark: SparkSession, n: int, n_products: int, n_customers: int, seed: int = 2) -> DataFrame:
    """One line per order; the total is price by quantity, shipping apart."""
    u = lambda i: uniform(seed + i, "id")
    quantity = F.floor(1 + u(1) * 5).cast("int")
    price = _money(u(2), 50, 15000)
    return spark.range(n).select(F.col("id").cast("string").alias("order_id"), F.floor(u(3) * n_customers).cast("string").alias("customer_id"), F.floor(u(4) * n_products).cast("string").alias("product_id"), quantity.alias("quantity"), price.alias("unit_price"), (price * quantity).cast("decimal(19,4)").alias("total_amount"), _money(u(5), 10, 60).alias("shipping_amount"), F.lit("PENDING").alias("status"))


def payments(orders_: DataFrame, seed: int = 3) -> DataFrame:
    """A payment for three in four orders, at most one each."""
    status = weighted(uniform(seed + 1, "order_id"), PAYMENT_WEIGHTS)
    rows = orders_.where(uniform(seed, "order_id") < 0.75).select(F.concat(F.lit("pay-"), "order_id").alias("payment_id"), "order_id", F.col("total_amount").alias("amount"), status.alias("status"))
    stamp = F.timestamp_seconds(F.lit(1_767_225_600) + F.floor(uniform(seed + 2, "order_id") * 86_400 * 90))
    return rows.withColumn("authorized_at", F.when(F.col("status").isin("AUTHORIZED", "PAID", "REFUNDED"), stamp)).withColumn("paid_at", F.when(F.col("status").isin("PAID", "REFUNDED"), stamp))


def shipments(orders_: DataFrame, seed: int = 4) -> DataFrame:
    status = weighted(uniform(seed, "order_id"), SHIPMENT_WEIGHTS)
    eta = F.date_add(F.to_date(F.lit("2026-01-01")), (2 + F.floor(uniform(seed + 1, "order_id") * 9)).cast("int"))
    return orders_.select(F.concat(F.lit("shp-"), "order_id").alias("shipment_id"), "order_id", status.alias("status"), eta.alias("estimated_delivery_at")).withColumn("delivered_at", F.when(F.col("status") == "DELIVERED", F.col("estimated_delivery_at")))


def reviews(orders_: DataFrame, seed: int = 5) -> DataFrame:
    return orders_.select(F.concat(F.lit("rev-"), "order_id").alias("review_id"), "order_id", "product_id", "customer_id", weighted(uniform(seed, "order_id"), RATING_WEIGHTS).cast("short").alias("rating"))


def inventories(spark: SparkSession, n: int, seed: int = 6) -> DataFrame:
    u = lambda i: uniform(seed + i, "id")
    return spark.range(n).select(F.col("id").cast("string").alias("inventory_id"), F.floor(20 + u(1) * 481).cast("int").alias("available_quantity"), F.floor(u(2) * 21).cast("int").alias("reserved_quantity"), F.floor(5 + u(3) * 16).cast("int").alias("minimum_quantity"))


def customers(spark: SparkSession, n: int, seed: int = 8) -> DataFrame:
    """Customers with an address: a complement for 30 %, a district for 90 %."""
    u = lambda i: uniform(seed + i, "id")
    name = F.concat(F.lit("Customer "), F.col("id"))
    return spark.range(n).select(F.col("id").cast("string").alias("customer_id"), name.alias("first_name"), F.concat(F.lit("customer"), F.col("id"), F.lit("@example.test")).alias("email"), (u(1) < 0.95).alias("is_active"), F.when(u(2) < 0.3, F.concat(F.lit("Unit "), F.floor(u(3) * 99))).alias("complement"), F.when(u(4) < 0.9, F.concat(F.lit("District "), F.floor(u(5) * 40))).alias("district"))


def reference_rows(spark: SparkSession, kind: str, codes: tuple[str, ...]) -> DataFrame:
    """Seed rows of a small reference table, to be inserted where absent."""
    return spark.createDataFrame([(f"{kind}-{i}", c, c.title(), True) for i, c in enumerate(codes)], f"{kind}_id string, code string, name string, is_active boolean")
