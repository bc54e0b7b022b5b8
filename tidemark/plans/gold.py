"""Gold as tables: models written once, partitioned, and shown as views; what builds on a written model reads it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import models

#: Columns a table is partitioned by.
PARTITIONS: dict[str, tuple[str, ...]] = {"fact_orders": ("order_year", "order_month")}
TABLES = ("fact_orders", "fact_order_status_transitions", "int_order_items_enriched", "dim_products")


def write_gold(spark: SparkSession, sources: Mapping[str, DataFrame], root: str, names: Sequence[str] = TABLES) -> dict[str, DataFrame]:
    """Write models below ``root``; returns them as read back.

    Rows of a partition meet before the write, a large partition is split.
    """
    done: dict[str, DataFrame] = {}
    for name in names:
        df = models.build(name, {**sources, **done})
        by, path = PARTITIONS.get(name, ()), f"{root.rstrip('/')}/gold/{name}"
        writer = (df.hint("rebalance", *by) if by else df).write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        done[name] = spark.read.schema(df.schema).parquet(path)
    return done


def show_views(tables: Mapping[str, DataFrame], prefix: str = "gold_") -> None:
    """A view of this session for each table, by its name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
