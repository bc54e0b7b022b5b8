import pytest

from tidemark.operators import quality
from tidemark.pipeline import Context, ParallelExecutor, PipelineBuilder, SequentialExecutor, Status
from tidemark.pipeline.core import Pipeline
from tidemark.pipeline.stages import BronzeStage, ExistenceGate, ExtractStage, QualityStage, ReconcileStage, RegisterStage, ship_rows
from tidemark.session import scratch
from tidemark.sources import generators, lake
from tidemark.sources.catalog import Catalog


def test_a_batch_from_source_to_catalogue(spark):
    root = scratch(spark, "batch")
    tables = {"customers": generators.customers(spark, 30), "orders": generators.orders(spark, 40, 5, 30)}
    bronze = {n: lake.VersionedTable(spark, f"{root}/bronze_batch/{n}") for n in tables}
    try:
        p = (
            PipelineBuilder()
            .named("batch")
            .add_group(*[ExtractStage(n, lambda df=df: df, root) for n, df in tables.items()])
            .add_stage(ReconcileStage({n: df.count for n, df in tables.items()}, {n: (lambda n=n: lake.read_raw(spark, f"{root}/raw/{n}").count()) for n in tables}))
            .add_stage(BronzeStage(spark, root, list(tables)))
            .add_stage(QualityStage(lambda: [quality.Test("ids", quality.not_null(bronze["customers"].read(), "customer_id"))]))
            .add_stage(RegisterStage(spark, "tm_batch", bronze))
            .build()
        )
        context = Context()
        r = ParallelExecutor().run(p, context)
        assert r.status is Status.COMPLETED, r
        assert context.get("storage.orders_path") and spark.table("tm_batch.orders").count() == 40
    finally:
        Catalog(spark).drop_database("tm_batch")


def test_failures_are_results_or_errors(spark):
    root = scratch(spark, "batch")
    run = lambda s: SequentialExecutor().run(Pipeline("p", (s,)))
    assert run(ExtractStage("x", lambda: spark.read.parquet(f"{root}/none"), root)).stages[0].message == "x is not there"
    assert run(ExistenceGate("g", root, "a")).status is Status.FAILED
    lake.ObjectStore(root).upload("a", b"1")
    assert run(ExistenceGate("g", root, "a")).status is Status.COMPLETED
    assert "bad (1)" in run(QualityStage(lambda: [quality.Test("bad", spark.range(1))])).stages[0].message
    assert isinstance(run(ReconcileStage({"t": lambda: 1}, {"t": lambda: 2})).error, quality.QualityError)
    log = lake.VersionedTable(spark, f"{root}/log")
    assert ship_rows(spark, [{"a": 1}], log) == 1 and log.read().count() == 1
    with pytest.raises(ValueError):
        ship_rows(spark, [], log)
    assert generators.reference_rows(spark, "carrier", ("A", "B")).count() == 2
