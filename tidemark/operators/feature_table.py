"""Per-entity feature table from events (problem 2).

Two-stage salted aggregation: each (entity, type) group is first aggregated in
``salts`` slices chosen by the event's own id, so that an entity holding a third
of all events is spread over ``salts`` tasks; the slices' partial statistics
are then merged, and ``expand_types`` lays the complete list of types out as
columns.

Defined results: an event without an entity is left out; a null amount counts
as 0; a null time leaves the latest time as it is (null if all are null); a
null type forms a group of its own; an empty input gives an empty table; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import micros


def latest_per_key(df: DataFrame, keys: dict[str, Column], order: Sequence[Column], payload: dict[str, Column]) -> DataFrame:
    """One row per key: ``payload`` of the row greatest in ``order``.

    An aggregation with map-side combine (sort-based, as the payload has
    texts), so a hot key is reduced before the shuffle. Nulls in ``order`` are smallest; full ties take the greatest
    payload, so the result does not depend on the order of rows.
    """
    row = F.struct(*[v.alias(k) for k, v in payload.items()])
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[v.alias(f"p{i}") for i, v in enumerate(payload.values())])
    best = df.groupBy(*[v.alias(k) for k, v in keys.items()]).agg(F.max_by(row, rank).alias("best"))
    return best.select(*keys, "best.*")


def entity_type_stats(df: DataFrame, entity: Column, kind: Column, event_id: Column, amount: Column, at: Column, salts: int = 16) -> DataFrame:
    """(entity, kind, n, total, last_us): one row for each pair that occurs.

    ``amount`` is a whole number (of the smallest unit), ``at`` a timestamp.
    """
    events = df.select(entity.alias("entity"), kind.alias("kind"), F.coalesce(amount, F.lit(0)).cast("long").alias("amount"), micros(at).alias("us"), F.pmod(F.xxhash64(event_id), F.lit(salts)).cast("int").alias("salt")).where(F.col("entity").isNotNull())
    sliced = events.groupBy("entity", "kind", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"), F.max("us").alias("last_us"))
    return sliced.groupBy("entity", "kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("last_us").alias("last_us"))


def found_types(stats: DataFrame) -> list[str]:
    """The complete type list, from the merged statistics: one name per type reaches the driver, as the columns of the table."""
    return sorted(r[0] for r in stats.select("kind").where(F.col("kind").isNotNull()).distinct().collect())


def expand_types(stats: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """One row per entity, for each of ``kinds`` (all found, if None) its n, total and last_us.

    A type without events gives 0, 0 and null. ``other_n`` counts events of no
    listed type, those of a null type included. The columns are named
    ``<kind>_n``, ``<kind>_total`` and ``<kind>_last_us`` in lower case.
    One map of at most ``len(kinds)`` entries per entity; hundreds of types
    cost one aggregation, not one join each.
    """
    kinds = found_types(stats) if kinds is None else kinds
    listed = F.coalesce(F.col("kind").isin(list(kinds)), F.lit(False))
    cell = F.when(listed, F.struct("kind", F.struct("n", "total", "last_us")))
    rows = stats.groupBy("entity").agg(F.sum("n").alias("events"), F.max("last_us").alias("last_us"), F.coalesce(F.sum(F.when(~listed, F.col("n"))), F.lit(0)).alias("other_n"), F.map_from_entries(F.collect_list(cell)).alias("m"))
    columns = []
    for kind in kinds:
        cell, name = F.try_element_at(F.col("m"), F.lit(kind)), kind.lower()
        columns += [F.coalesce(cell["n"], F.lit(0)).alias(f"{name}_n"), F.coalesce(cell["total"], F.lit(0)).alias(f"{name}_total"), cell["last_us"].alias(f"{name}_last_us")]
    return rows.select("entity", "events", F.col("last_us").alias("any_last_us"), "other_n", *columns)
