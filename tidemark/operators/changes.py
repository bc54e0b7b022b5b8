"""Decoding of landed change records: completeness and row key.

Stays in the JVM: the record is parsed once into a variant. A record that is
no complete JSON gives ``complete`` false; a null record is complete and has a
null key, as has a record without the entity's key field or of an unknown
entity. A record that repeats a field name counts as incomplete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_fields(entity_fields: DataFrame) -> dict[str, str]:
    """entity -> its row-key field, from the declared fields (a fixed, small table)."""
    rows = entity_fields.where(F.col("is_row_key")).select("entity", "field_name").distinct().collect()
    return {r[0]: r[1] for r in rows}


def with_row_key(changes: DataFrame, keys: dict[str, str], record: str = "record", entity: str = "entity") -> DataFrame:
    """Adds ``variant``, ``complete`` and ``row_key``."""
    parsed = changes.withColumn("variant", F.try_parse_json(F.col(record)))
    key: Column = F.lit(None).cast("string")
    for name, field in sorted(keys.items(), reverse=True):
        key = F.when(F.col(entity) == name, F.try_variant_get("variant", f'$["{field}"]', "string")).otherwise(key)
    return parsed.withColumn("complete", F.col(record).isNull() | F.col("variant").isNotNull()).withColumn("row_key", key)
