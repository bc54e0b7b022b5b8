"""Ready stages: extract, gate, reconcile, ingest, test, register."""

from __future__ import annotations

import asyncio
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import quality
from tidemark.pipeline.core import Context, Stage, StageResult
from tidemark.sources import lake
from tidemark.sources.catalog import Catalog


class ExtractStage(Stage):
    """Land a source's rows under raw; a source that is not there is a FAILED result, other errors are raised."""

    def __init__(self, entity: str, read: Callable[[], DataFrame], root: str, clear: bool = True) -> None:
        super().__init__(f"extract_{entity}")
        self.entity, self.read, self.root, self.clear = entity, read, root, clear

    async def execute(self, context: Context) -> StageResult:
        def run() -> str:
            return lake.land_raw(self.read(), self.root, self.entity, self.clear)

        try:
            path = await asyncio.to_thread(run)
        except Exception as e:
            if any(sign in str(e) for sign in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND")):
                return self.failed(f"{self.entity} is not there")
            raise
        context.write("storage", **{f"{self.entity}_path": path})
        return self.completed(path=path)


class ExistenceGate(Stage):
    """FAILED unless an object is there; publishes its address, size and time."""

    def __init__(self, stage_id: str, root: str, key: str) -> None:
        super().__init__(stage_id)
        self.store, self.root, self.key = lake.ObjectStore(root), root, key

    async def execute(self, context: Context) -> StageResult:
        if not self.store.exists(self.key):
            return self.failed(f"no object {self.key}")
        context.write("storage", uri=f"{self.root.rstrip('/')}/{self.key}", key=self.key, **self.store.head(self.key))
        return self.completed()


class ReconcileStage(Stage):
    """Raise unless every landed table has as many rows as its source."""

    def __init__(self, source: Mapping[str, Callable[[], int]], landed: Mapping[str, Callable[[], int]]) -> None:
        super().__init__("reconcile", max_attempts=1)
        self.source, self.landed = source, landed

    async def execute(self, context: Context) -> StageResult:
        def run() -> dict[str, int]:
            counts = {t: f() for t, f in self.landed.items()}
            quality.reconcile({t: f() for t, f in self.source.items()}, counts)
            return counts

        return self.completed(**{"counts": await asyncio.to_thread(run)})


class BronzeStage(Stage):
    """raw -> Bronze for many entities."""

    def __init__(self, spark: SparkSession, root: str, entities: Sequence[str]) -> None:
        super().__init__("bronze")
        self.spark, self.root, self.entities = spark, root, entities

    async def execute(self, context: Context) -> StageResult:
        counts = await asyncio.to_thread(lake.ingest_bronze, self.spark, self.root, self.entities)
        return self.completed(**{"counts": counts})


class QualityStage(Stage):
    """FAILED with the names of the tests that have failing rows."""

    def __init__(self, tests: Callable[[], Sequence[quality.Test]]) -> None:
        super().__init__("quality", max_attempts=1)
        self.tests = tests

    async def execute(self, context: Context) -> StageResult:
        try:
            await asyncio.to_thread(lambda: quality.require(quality.run_suite(self.tests())))
        except quality.QualityError as e:
            return self.failed(str(e))
        return self.completed()


class RegisterStage(Stage):
    """Register versioned tables' current parts in the catalogue."""

    def __init__(self, spark: SparkSession, database: str, tables: Mapping[str, lake.VersionedTable]) -> None:
        super().__init__("register")
        self.catalog, self.database, self.tables = Catalog(spark), database, tables

    async def execute(self, context: Context) -> StageResult:
        def run() -> list[str]:
            self.catalog.create_database(self.database)
            new = []
            for name, t in self.tables.items():
                schema = t.schema()
                if schema is None:
                    raise FileNotFoundError(t.path)
                if self.catalog.register(f"{self.database}.{name}", f"{t.path}/{t.state['parts'][-1]}", schema, t.format):
                    new.append(name)
            return new

        return self.completed(registered=await asyncio.to_thread(run))


def ship_rows(spark: SparkSession, rows: Sequence[Mapping[str, Any]], target: lake.VersionedTable) -> int:
    """Append a run's log or metric rows to a table; returns how many. No rows are an error."""
    if not rows:
        raise ValueError("nothing to ship")
    target.write(spark.createDataFrame([dict(r) for r in rows]), lake.SaveMode.APPEND)
    return len(rows)
