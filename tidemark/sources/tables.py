"""Parquet table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, root: str, name: str, schema: StructType | None = None) -> DataFrame:
    """``<root>/<name>.parquet``, a file or a folder of files."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{root}/{name}.parquet")
