"""Relational sources: closed type maps and partitioned JDBC scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Type ids of the source's wire protocol.
TYPE_IDS = {16: "bool", 21: "smallint", 23: "integer", 25: "text", 1043: "varchar", 1082: "date", 1184: "timestamptz", 2950: "uuid", 1700: "numeric"}
#: Names in information_schema.columns.data_type.
TYPE_NAMES = {"boolean": "bool", "smallint": "smallint", "integer": "integer", "text": "text", "character varying": "varchar", "date": "date", "timestamp with time zone": "timestamptz", "uuid": "uuid", "numeric": "numeric"}
_SPARK = {"bool": T.BooleanType(), "smallint": T.ShortType(), "integer": T.IntegerType(), "text": T.StringType(), "varchar": T.StringType(), "date": T.DateType(), "timestamptz": T.TimestampType(), "uuid": T.StringType()}


def spark_type(column: str, source: int | str, precision: int | None = None, scale: int | None = None) -> T.DataType:
    """The Spark type of a source type id or name; an unknown one is an error, as is numeric without precision."""
    kind = TYPE_IDS.get(source) if isinstance(source, int) else TYPE_NAMES.get(source)
    if kind is None:
        raise ValueError(f"column {column!r}: source type {source!r} is not mapped")
    if kind == "numeric":
        if precision is None or scale is None:
            raise ValueError(f"column {column!r}: numeric without precision and scale")
        return T.DecimalType(precision, scale)
    return _SPARK[kind]


def table_schema(columns: Sequence[tuple[str, int | str, int | None, int | None]], provenance: bool = False) -> T.StructType:
    """Schema from (name, type, precision, scale) in order; ``provenance`` adds ``_cdc_ts_ms``."""
    if not columns:
        raise ValueError("no columns: unknown entity?")
    fields = [T.StructField(n, spark_type(n, t, p, s)) for n, t, p, s in columns]
    return T.StructType([*fields, T.StructField("_cdc_ts_ms", T.LongType())] if provenance else fields)


def quoted(identifier: str) -> str:
    """A quoted SQL identifier."""
    return '"' + identifier.replace('"', '""') + '"'


def read_table(spark: SparkSession, url: str, table: str, split_on: str | None = None, low: int | None = None, high: int | None = None, splits: int = 16, fetch: int = 10_000, **options: str) -> DataFrame:
    """A table over JDBC, read by ``splits`` tasks along a numeric or time column where one is named.

    Filters and column lists reach the source; rows are fetched in pages.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", ".".join(map(quoted, table.split(".")))).option("fetchsize", fetch)
    for k, v in options.items():
        reader = reader.option(k, v)
    if split_on is not None:
        reader = reader.option("partitionColumn", split_on).option("lowerBound", low).option("upperBound", high).option("numPartitions", splits)
    return reader.load()
