"""Catalogue of databases and tables over Spark's."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

#: Catalogue names of Spark's simple types.
CATALOG_TYPES = {"string": "string", "bigint": "bigint", "int": "int", "smallint": "smallint", "tinyint": "tinyint", "double": "double", "float": "float", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "binary": "binary"}


def catalog_type(spark_type: str) -> str:
    """The catalogue's name of a type; nested types are an error."""
    name = spark_type.lower()
    if re.fullmatch(r"decimal\(\d+,\s*\d+\)", name):
        return name
    if name not in CATALOG_TYPES:
        raise ValueError(f"type {spark_type!r} cannot be registered")
    return CATALOG_TYPES[name]


def catalog_columns(schema: StructType) -> list[tuple[str, str]]:
    return [(f.name, catalog_type(f.dataType.simpleString())) for f in schema.fields]


def schema_name(custom: str | None, target: str) -> str:
    """A custom schema is used as it is, else the target's."""
    return custom.strip() if custom and custom.strip() else target


def _q(name: str) -> str:
    return ".".join(f"`{p}`" for p in name.split("."))


class Catalog:
    """Databases and tables; registering what exists changes nothing."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def create_database(self, name: str) -> None:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {_q(name)}")

    def database_exists(self, name: str) -> bool:
        return self.spark.catalog.databaseExists(name)

    def drop_database(self, name: str) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {_q(name)} CASCADE")

    def databases(self) -> list[str]:
        return [d.name for d in self.spark.catalog.listDatabases()]

    def register(self, name: str, path: str, schema: StructType, file_format: str = "parquet") -> bool:
        """Create an external table; False if it was there, an error if it was there with other columns."""
        wanted = catalog_columns(schema)
        columns = ", ".join(f"`{n}` {t}" for n, t in wanted)
        if self.table_exists(name):
            if sorted(self.columns(name)) != sorted((n, t) for n, t in wanted):
                raise ValueError(f"{name} is registered with other columns: {self.columns(name)}")
            return False
        self.spark.sql(f"CREATE TABLE {_q(name)} ({columns}) USING {file_format} LOCATION '{path}'")
        return True

    def crawl(self, name: str, path: str, file_format: str = "parquet") -> bool:
        """Register what lies at a path under the schema it has."""
        return self.register(name, path, self.spark.read.format(file_format).load(path).schema, file_format)

    def table_exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def drop_table(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {_q(name)}")

    def tables(self, database: str) -> list[str]:
        return [t.name for t in self.spark.catalog.listTables(database) if not t.isTemporary]

    def columns(self, name: str) -> list[tuple[str, str]]:
        return [(c.name, c.dataType) for c in self.spark.catalog.listColumns(name)]

    def location(self, name: str) -> str:
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {_q(name)}").where("col_name = 'Location'").limit(1).collect()
        return rows[0]["data_type"]

    def set_location(self, name: str, path: str) -> None:
        self.spark.sql(f"ALTER TABLE {_q(name)} SET LOCATION '{path}'")
        self.spark.catalog.refreshTable(name)

    def repair(self, name: str) -> None:
        """Find the partitions that lie in the table's folder."""
        self.spark.sql(f"MSCK REPAIR TABLE {_q(name)}")
