"""Row-level writes of an operational store, as set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_absent(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows to append: of each key that the target lacks the least row, whatever their order."""
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__row")).select(*keys, "__row.*") if rest else rows.distinct()
    return one.select(*rows.columns).join(target.select(*keys), list(keys), "left_anti")


def update_where(df: DataFrame, condition: Column, changes: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The table after an UPDATE ... WHERE, and the rows it changed (as they are now)."""
    hit = F.coalesce(condition, F.lit(False))
    marked = df.withColumn("__hit", hit)
    new = marked.select(*[F.when(F.col("__hit"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns], "__hit")
    return new.drop("__hit"), new.where("__hit").drop("__hit")


def due_candidates(df: DataFrame, status: str, age: str, limit: int = 15, now: Column | None = None, tiebreak: str | None = None) -> DataFrame:
    """The ``limit`` longest unchanged rows of a status, unchanged for at least ``age`` (``60 seconds``); ties by a key."""
    moment = F.current_timestamp() if now is None else now
    return df.where((F.col("status") == status) & (F.col("updated_at") <= moment - F.expr(f"INTERVAL {age}"))).orderBy("updated_at", *([tiebreak] if tiebreak else [])).limit(limit)


def priority_pick(df: DataFrame, first: Column, tiebreak: Column, n: int = 1) -> DataFrame:
    """``n`` rows, those that meet ``first`` before others, then by ``tiebreak`` (``rand()`` for a draw)."""
    return df.orderBy(first.cast("int").desc_nulls_last(), tiebreak).limit(n)
