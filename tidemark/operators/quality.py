"""Data-quality tests as DataFrames of failing rows, and profiles.

A test passes when its DataFrame is empty. ``run_suite`` counts the failing
rows of many tests in one job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    """(column, n_records) of values that occur more than once; nulls do not count."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_records")).where(F.col("n_records") > 1)


def relationships(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose non-null key is not in the parent."""
    keys = parent.select(F.col(parent_column).alias(column))
    return child.where(F.col(column).isNotNull()).join(keys, column, "left_anti")


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """(value, n_records) outside of ``values``; null passes."""
    bad = df.where(F.col(column).isNotNull() & ~F.col(column).isin(list(values)))
    return bad.groupBy(F.col(column).alias("value_field")).agg(F.count(F.lit(1)).alias("n_records"))


def non_negative_duration(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) < 0)


def not_before(df: DataFrame, later: str, earlier: str) -> DataFrame:
    """Rows with ``later`` before ``earlier``; a null ``later`` passes."""
    return df.where(F.col(later).isNotNull() & (F.col(later) < F.col(earlier)))


def at_most_once(df: DataFrame, key: str, condition: Column) -> DataFrame:
    """(key, n) of keys for which ``condition`` holds more than once."""
    return df.where(condition).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def check(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that break a CHECK constraint; as in SQL, unknown passes."""
    return df.where(~condition)


#: CHECK constraints of the source tables: table -> name -> condition.
CONSTRAINTS: dict[str, dict[str, Column | str]] = {
    "customers": {"email_form": "email LIKE '%@%'"},
    "sellers": {"email_form": "email LIKE '%@%'"},
    "carriers": {"email_form": "email LIKE '%@%'"},
    "inventories": {"available": "available_quantity >= 0", "reserved": "reserved_quantity >= 0", "minimum": "minimum_quantity >= 0"},
    "inventory_movements": {"quantity": "quantity > 0", "kind": "movement_type IN ('INBOUND', 'OUTBOUND', 'RESERVATION', 'RELEASE', 'ADJUSTMENT')"},
    "order_items": {"quantity": "quantity > 0", "unit_price": "unit_price >= 0", "total_price": "total_price >= 0"},
    "orders": {"total": "total_amount >= 0", "shipping": "shipping_amount >= 0", "status": "status IN ('PENDING', 'PAID', 'PROCESSING', 'SHIPPED', 'DELIVERED', 'CANCELLED')"},
    "payments": {"amount": "amount >= 0", "status": "status IN ('PENDING', 'AUTHORIZED', 'PAID', 'FAILED', 'CANCELLED', 'REFUNDED')"},
    "products": {"price": "price >= 0", "status": "status IN ('ACTIVE', 'INACTIVE', 'OUT_OF_STOCK')"},
    "refunds": {"amount": "amount >= 0"},
    "reviews": {"rating": "rating BETWEEN 1 AND 5"},
    "shipments": {"status": "status IN ('CREATED', 'SHIPPED', 'IN_TRANSIT', 'DELIVERED', 'RETURNED')"},
    "customer_addresses": {"kind": "address_type IN ('HOME', 'WORK', 'DELIVERY', 'BILLING')"},
}


def broken_constraints(df: DataFrame, table: str, constraints: Mapping[str, str] | None = None) -> DataFrame:
    """(constraint_name, n_rows) of every constraint, in one pass over the table."""
    rules = CONSTRAINTS[table] if constraints is None else constraints
    counts = df.agg(*[F.count_if(~F.expr(rule)).alias(name) for name, rule in rules.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("constraint_name"), F.col(n).alias("n_rows")) for n in rules])))


@dataclass(frozen=True)
class Test:
    name: str
    failures: DataFrame


def run_suite(tests: Sequence[Test]) -> DataFrame:
    """(test_name, n_failures, passed), one row per test."""
    counts = [t.failures.agg(F.count(F.lit(1)).alias("n_failures")).select(F.lit(t.name).alias("test_name"), "n_failures") for t in tests]
    return reduce(DataFrame.unionByName, counts).withColumn("passed", F.col("n_failures") == 0)


_STATUSES = ("PENDING", "PAID", "PROCESSING", "SHIPPED", "DELIVERED", "CANCELLED")
#: The tests declared for the facts, as (table, column, kind, argument).
DECLARED: tuple[tuple, ...] = (
    ("fact_orders", "order_id", "not_null", None),
    ("fact_orders", "order_id", "unique", None),
    ("fact_orders", "order_status", "accepted_values", _STATUSES),
    ("fact_orders", "order_value_tier", "not_null", None),
    ("fact_orders", "order_value_tier", "accepted_values", (1, 2, 3)),
    ("fact_orders", "order_year", "not_null", None),
    ("fact_orders", "order_month", "not_null", None),
    ("transitions", "history_id", "not_null", None),
    ("transitions", "history_id", "unique", None),
    ("transitions", "order_id", "not_null", None),
    ("transitions", "order_id", "relationships", ("orders", "order_id")),
    ("transitions", "current_status", "accepted_values", _STATUSES),
    ("transitions", "previous_status", "accepted_values", _STATUSES[:4]),
    ("items", "order_item_id", "not_null", None),
    ("items", "order_item_id", "unique", None),
    ("items", "order_id", "relationships", ("orders", "order_id")),
    ("items", "product_id", "relationships", ("products", "product_id")),
)


def declared(tables: Mapping[str, DataFrame], name: str, column: str, kind: str, argument) -> Test:
    """A declared test on one of ``tables``."""
    df, label = tables[name], f"{name}.{column} {kind}"
    if kind == "relationships":
        return Test(label, relationships(df.select(column), column, tables[argument[0]], argument[1]))
    if kind == "accepted_values":
        return Test(label, accepted_values(df, column, argument))
    return Test(label, {"not_null": not_null, "unique": unique}[kind](df, column))


class QualityError(RuntimeError):
    """A suite had failing rows."""


def require(summary: DataFrame) -> None:
    """Raise with the names of failed tests (one row per test reaches the driver)."""
    failed = [f"{r['test_name']} ({r['n_failures']})" for r in summary.where(~F.col("passed")).collect()]
    if failed:
        raise QualityError(", ".join(failed))


def profile_nulls(df: DataFrame) -> DataFrame:
    """(column_name, n_rows, n_null, n_blank) of each column in one aggregation; only strings can be blank."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        blank = F.count_if(c == "") if isinstance(f.dataType, StringType) else F.lit(0).cast("bigint")
        parts.append(F.struct(F.lit(f.name).alias("column_name"), F.count(F.lit(1)).alias("n_rows"), F.count_if(c.isNull()).alias("n_null"), blank.alias("n_blank")))
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def profile_repeats(df: DataFrame) -> DataFrame:
    """Whole rows that occur more than once, with ``n_copies``."""
    return df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("n_copies")).where(F.col("n_copies") > 1)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows)."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, df in tables.items()])


def reconcile(source: Mapping[str, int], landed: Mapping[str, int]) -> None:
    """Raise if any table's landed row count differs from its source's."""
    off = [f"{t}: source {n}, landed {landed.get(t)}" for t, n in source.items() if landed.get(t) != n]
    if off:
        raise QualityError("; ".join(off))
