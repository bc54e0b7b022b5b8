"""Queries of the general problems (2, 3, 6, 7, 4, 5, 1) over the marketplace tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import e4, label_key, ref_key
from tidemark.operators import cdc_apply, changes, dedup_index, feature_table, hierarchy, history, orphans, schema_drift
from tidemark.session import materialize, scratch
from tidemark.sources.tables import table

ORDER_STATUSES = ("PENDING", "PAID", "PROCESSING", "SHIPPED", "DELIVERED", "CANCELLED")


def _current_orders(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "marketplace_orders")
    payload = {"customer": ref_key("customer_id"), "status": label_key("status"), "amount": e4("total_amount"), "created_at": F.col("created_at")}
    return feature_table.latest_per_key(orders, {"order_id": ref_key("order_id")}, [F.col("updated_at"), F.col("processed_at")], payload)


def _order_stats(spark: SparkSession, d: str) -> DataFrame:
    o = _current_orders(spark, d)
    return feature_table.entity_type_stats(o, F.col("customer"), F.col("status"), F.col("order_id"), F.col("amount"), F.col("created_at"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per customer and order status that occurs."""
    return _order_stats(spark, d).select(F.col("entity").alias("customer_id"), F.col("kind").alias("status"), F.col("n").alias("n_orders"), F.col("total").alias("total_e4"), F.col("last_us").alias("last_created_us"))


def p2_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per customer with the columns of every order status, the known ones and what else is found."""
    stats = materialize(_order_stats(spark, d), "order-stats")
    kinds = sorted({*ORDER_STATUSES, *feature_table.found_types(stats)})
    return feature_table.expand_types(stats, kinds).withColumnRenamed("entity", "customer_id")


def _category_nodes(spark: SparkSession, d: str) -> DataFrame:
    payload = {"category_id": F.col("category_id"), "parent": ref_key("parent_category_id")}
    return feature_table.latest_per_key(table(spark, d, "categories"), {"id": ref_key("category_id")}, [F.col("updated_at"), F.col("processed_at")], payload)


def _category_levels(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(_category_nodes(spark, d).select("id", "parent"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Root, depth and number of descendants of each category."""
    return _category_levels(spark, d).select(F.col("id").alias("category_id"), F.col("root").alias("root_category_id"), "depth", "n_descendants")


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """The path of ids from the root to each category, joined by '/'."""
    nodes = _category_nodes(spark, d).select("id", "parent")
    levels = hierarchy.hierarchy(nodes)
    return hierarchy.paths(nodes, levels).select(F.col("id").alias("category_id"), F.concat_ws("/", "path").alias("path"))


def p3_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The nested-set range of each category: what lies in it is the category and all below it."""
    levels = _category_levels(spark, d).where(F.col("pos").isNotNull())
    return levels.select(F.col("id").alias("category_id"), "pos", "size")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a root category and a category below it, from nested-set ranges."""
    levels = _category_levels(spark, d)
    found = hierarchy.descendants(levels, levels.where(F.col("depth") == 0))
    return found.select(F.col("ancestor").alias("root_category_id"), F.col("id").alias("category_id"))


def p3_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a category and another one reached from it downwards, inner ones and those on or below loops included."""
    found = hierarchy.all_descendants(materialize(_category_levels(spark, d), "levels"))
    return found.select(F.col("ancestor").alias("category_id"), F.col("id").alias("descendant_id"))


def _references(spark: SparkSession, d: str) -> tuple[list[orphans.Child], list[orphans.Parent]]:
    def child(name: str, row_id: str, refs: dict[str, str]) -> orphans.Child:
        return orphans.Child(table(spark, d, name), name, row_id, "created_at", "processed_at", refs)

    children = [child("order_items", "order_item_id", {"order_id": "orders", "product_id": "products"}), child("payments", "payment_id", {"order_id": "orders"}), child("shipments", "shipment_id", {"order_id": "orders"})]
    parents = [orphans.Parent(table(spark, d, "marketplace_orders"), "orders", "order_id", "processed_at"), orphans.Parent(table(spark, d, "products"), "products", "product_id", "processed_at", "deleted_at")]
    return children, parents


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Child rows whose reference is missing, deleted or late."""
    return orphans.broken_references(*_references(spark, d))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Broken references per table, field, problem and month."""
    return orphans.broken_reference_counts(*_references(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every version of price and status of each product with the time it held."""
    payload = {"price_e4": e4("price"), "status": label_key("status")}
    snapshot = F.date_format("processing_date", "yyyy-MM")
    versions = history.version_history(table(spark, d, "products"), ref_key("product_id"), F.col("updated_at"), F.col("processed_at"), snapshot, payload, F.col("deleted_at"))
    return versions.withColumnRenamed("entity", "product_id")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    keys = changes.key_fields(table(spark, d, "entity_fields"))
    return changes.with_row_key(table(spark, d, "cdc_changes"), keys)


def _applied(spark: SparkSession, d: str, payload: bool) -> cdc_apply.UpsertTable:
    size = F.coalesce(F.sum(F.octet_length("record")), F.lit(0)) if payload else F.lit(0)
    total, size = table(spark, d, "cdc_changes").agg(F.count(F.lit(1)), size).first()
    target = cdc_apply.UpsertTable(spark, scratch(spark, "upsert"))
    target.apply(cdc_apply.normalize_changes(_changes(spark, d), payload), total, size)
    return target


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The keys alive after all changes, with the position of the change that set them."""
    rows = _applied(spark, d, payload=False).rows(columns=["source", "entity", "row_key", "seq"])
    return rows.select(F.col("source").alias("source_db"), "entity", "row_key", F.col("seq").alias("lsn"))


def p4_state(spark: SparkSession, d: str) -> DataFrame:
    """The current rows themselves, as the record that set them."""
    rows = _applied(spark, d, payload=True).rows()
    return rows.select(F.col("source").alias("source_db"), "entity", "row_key", F.col("seq").alias("lsn"), F.col("payload").alias("record"))


#: More than the runs a prefix may have, so that they are merged.
DELIVERIES = dedup_index.MAX_RUNS + 2


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The rows that repeat a change already received, deliveries taken in turn."""
    landed = _changes(spark, d)
    ids = [F.col("source_db"), F.col("entity"), F.col("lsn"), F.col("row_key")]
    low, high = table(spark, d, "cdc_changes").agg(F.min("arrival_id"), F.max("arrival_id")).first()
    if low is None:
        return spark.createDataFrame([], "arrival_id long")
    width = (high - low) // DELIVERIES + 1
    at = F.col("arrival_id")
    parts = [landed.where(F.col("complete") & (at >= low + i * width) & (at < low + (i + 1) * width)) for i in range(DELIVERIES)]
    found = dedup_index.repeated_rows(parts, ids, at, scratch(spark, "ids"))
    return found.withColumnRenamed("row_id", "arrival_id")


def _records(spark: SparkSession, d: str) -> DataFrame:
    counted = _changes(spark, d).where(F.col("op").isin(*schema_drift.ROW_OPS) & F.col("variant").isNotNull() & F.col("lsn").isNotNull())
    return counted.select(F.col("source_db").alias("source"), "entity", F.col("lsn").alias("seq"), "row_key", "record")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every field added, removed, renamed or retyped."""
    events = schema_drift.drift_events(_records(spark, d))
    return events.select(F.col("source").alias("source_db"), "entity", "change_kind", "field_name", "new_name", F.col("seq").alias("first_lsn"))


def _unified(entity: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return schema_drift.unify(_records(spark, d), table(spark, d, "entity_fields"), entity)

    query.__doc__ = f"All complete {entity} records in one consistent table."
    return query


QUERIES = {"p2_found": p2_found, "p2_features": p2_features, "p3_found": p3_found, "p3_paths": p3_paths, "p3_ranges": p3_ranges, "p3_descendants": p3_descendants, "p3_all_descendants": p3_all_descendants, "p6_found": p6_found, "p6_counts": p6_counts, "p7_found": p7_found, "p4_found": p4_found, "p4_state": p4_state, "p5_found": p5_found, "p1_found": p1_found, **{f"p1_{e}_table": _unified(e) for e in ("orders", "products", "payments", "shipments", "inventories", "reviews")}}
