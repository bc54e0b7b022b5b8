"""Bronze to Silver standardization: names, blanks, duplicates, audit columns."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def snake_name(name: str) -> str:
    """``CustomerId`` -> ``customer_id``; separators become one underscore, other signs go."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)
    kept = re.sub(r"[^A-Za-z0-9_]", "", re.sub(r"[\s./-]+", "_", spaced))
    return "_".join(part for part in kept.split("_") if part).lower()


def normalize_names(df: DataFrame) -> DataFrame:
    """Rename all columns by ``snake_name``; an empty or repeated new name is an error."""
    names = [snake_name(c) for c in df.columns]
    clashes = sorted(n or "(empty)" for n, k in Counter(names).items() if k > 1 or not n)
    if clashes:
        raise ValueError(f"columns {df.columns} give unusable names: {', '.join(clashes)}")
    return df.toDF(*names)


def trim_strings(df: DataFrame) -> DataFrame:
    """Trim spaces (not tabs or line ends) of every string column, in one projection."""
    return df.select(*[F.trim(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def drop_repeats(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat a whole row, or with ``subset`` its values, go; which row stays then is open."""
    return df.dropDuplicates(list(subset)) if subset else df.distinct()


def latest_by_key(df: DataFrame, keys: Sequence[str], order: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The row of each key that is greatest in ``order``, then in ``tiebreak``, then in all columns.

    One hash-partitioned aggregation with map-side combine: a key with a third
    of all rows sends one row per input partition. Nulls are smallest; null keys
    are one key.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns])
    rank = F.struct(*[F.col(f"`{c}`") for c in (order, *tiebreak)], row)
    best = df.groupBy(*[F.col(f"`{k}`").alias(f"__key{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, rank).alias("__row"))
    return best.select("__row.*")


def add_audit(df: DataFrame) -> DataFrame:
    """``processed_at`` and ``processing_date``, the same for all rows of a query."""
    return df.withColumn("processed_at", F.current_timestamp()).withColumn("processing_date", F.current_date())


def standardize(df: DataFrame, natural_key: Sequence[str] | None = None, order: str = "cdc_ts_ms") -> DataFrame:
    """Names, blanks, whole-row duplicates, optionally the latest row per key, audit columns.

    ``natural_key`` and ``order`` are names after normalization (a leading
    underscore is gone by then).
    """
    clean = drop_repeats(trim_strings(normalize_names(df)))
    if natural_key:
        clean = latest_by_key(clean, natural_key, order)
    return add_audit(clean)
