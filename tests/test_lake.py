import time

import pytest
from pyspark.sql import types as T

from tidemark.session import scratch
from tidemark.sources import catalog, generators, jdbc, kafka, lake


def test_locations():
    at = lake.Location.parse("S3://bucket//a///b/")
    assert (at.scheme, at.key, at.uri, at.name, at.parent) == ("s3", "a/b/", "s3://bucket/a/b/", "b", "a/")
    for bad in ("s3://bucket", "bucket/key", "s3:///key", "s3://bucket/"):
        with pytest.raises(ValueError):
            lake.Location.parse(bad)


def test_dataset_paths_and_partitions(spark):
    data = lake.Dataset("gold", "sales", "orders", partitioning=lake.Partitioning.COLUMN, partition_columns=("year", "month"))
    assert data.path({"year": 2026, "month": 7}, "f.parquet") == "gold/sales/orders/year=2026/month=7/f.parquet"
    root = scratch(spark, "ds")
    df = spark.createDataFrame([(1, 2026, 1), (2, 2026, 2)], "id int, year int, month int")
    path = data.write(df, root)
    assert spark.read.parquet(path).where("month = 2").count() == 1
    data.write(df, root, lake.SaveMode.APPEND)
    assert spark.read.parquet(path).count() == 4
    data.write(df, root, lake.SaveMode.IGNORE)
    assert spark.read.parquet(path).count() == 4
    for fmt in (lake.FileFormat.JSON, lake.FileFormat.CSV):
        lake.Dataset("raw", "sales", fmt.value, fmt, lake.Compression.GZIP, lake.Partitioning.HASH, ("id",), 2).write(df, root)


def test_versioned_table(spark):
    t = lake.VersionedTable(spark, scratch(spark, "vt"))
    assert not t.exists() and t.schema() is None
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    t.write(df)
    t.write(df, "append", key="x")
    t.write(df, "append", key="x")
    assert t.read().count() == 4 and t.schema() == df.schema
    # A table can be rewritten from itself.
    t.write(t.read().where("id = 1"), lake.SaveMode.OVERWRITE)
    assert t.read().count() == 2
    with pytest.raises(FileExistsError):
        t.write(df, lake.SaveMode.ERROR)
    assert t.vacuum(168) == 0 and t.read().count() == 2
    time.sleep(0.05)
    assert t.vacuum(0) > 0 and t.read().count() == 2


def test_appended_parts_merge_their_columns(spark):
    t = lake.VersionedTable(spark, scratch(spark, "vt"))
    t.write(spark.createDataFrame([(1, "a")], "id long, x string"))
    t.write(spark.createDataFrame([(2, 5)], "id long, y int"), "append")
    assert sorted(map(tuple, t.read().collect())) == [(1, "a", None), (2, None, 5)]
    with pytest.raises(ValueError, match="'x'"):
        t.write(spark.createDataFrame([(3, 4)], "id long, x int"), "append")
    assert t.read().count() == 2


def test_a_batch_that_was_compacted_is_not_taken_again(spark):
    t = lake.VersionedTable(spark, scratch(spark, "vt"))
    for n in range(2):
        t.write(spark.range(10), "append", key=f"{n:04}")
    assert t.compact()[1] == 1
    t.write(spark.range(10), "append", key="0001")
    t.write(spark.range(5), "append", key="0002")
    t.write(spark.range(5), "append", key="0002")
    assert t.read().count() == 25


def test_compaction_is_idempotent(spark):
    t = lake.VersionedTable(spark, scratch(spark, "vt"))
    t.write(spark.range(100).repartition(9))
    assert t.compact() == (9, 1) and t.compact() == (1, 1) and t.read().count() == 100 and t.detail().files == 1


def test_empty_table_keeps_its_schema(spark):
    t = lake.VersionedTable(spark, scratch(spark, "vt"))
    t.write(spark.createDataFrame([], "a string, b decimal(10,2)"))
    assert t.read().columns == ["a", "b"] and t.read().count() == 0


def test_objects_and_landing(spark):
    root = scratch(spark, "obj")
    s = lake.ObjectStore(root)
    s.upload("a/b", b"x")
    s.copy("a/b", "c")
    s.move("c", "d/e")
    assert s.list() == ["a/b", "d/e"] and s.download("d/e") == b"x" and s.head("a/b")["size"] == 1 and not s.exists("c")
    with pytest.raises(FileNotFoundError):
        s.head("nope")
    df = spark.createDataFrame([(1,)], "id int")
    lake.land_raw(df, root, "t")
    lake.land_raw(df, root, "t")
    assert lake.read_raw(spark, f"{root}/raw/t").count() == 2
    lake.land_raw(df, root, "t", clear=True)
    assert lake.ingest_bronze(spark, root, ["t"]) == {"t": 1}
    with pytest.raises(RuntimeError, match="missing"):
        lake.ingest_bronze(spark, root, ["t", "missing"])


def test_source_types():
    schema = jdbc.table_schema([("id", 2950, None, None), ("n", "numeric", 19, 4), ("ok", 16, None, None)], provenance=True)
    assert [f.dataType.simpleString() for f in schema.fields] == ["string", "decimal(19,4)", "boolean", "bigint"]
    for bad in (("n", 1700, None, None), ("x", 9999, None, None), ("x", "jsonb", None, None)):
        with pytest.raises(ValueError):
            jdbc.spark_type(*bad)
    with pytest.raises(ValueError):
        jdbc.table_schema([])
    assert jdbc.quoted('a"b') == '"a""b"'


def test_lag():
    assert kafka.lag(None) is None and kafka.lag({"sources": []}) == 0
    progress = {"sources": [{"startOffset": '{"t": {"0": 5, "1": 2}}', "endOffset": '{"t": {"0": 7}}', "latestOffset": '{"t": {"0": 10, "1": 6, "2": 1}}'}]}
    assert kafka.lag(progress) == 3 + 4 + 1
    assert kafka.stream_options("h", ["a", "b"])["minOffsetsPerTrigger"] == "100"


def test_catalog(spark):
    c = catalog.Catalog(spark)
    c.create_database("tm_test")
    try:
        path = scratch(spark, "cat")
        df = spark.createDataFrame([(1, "a")], "id long, name string")
        df.write.parquet(path)
        assert c.crawl("tm_test.t", path) and not c.crawl("tm_test.t", path)
        assert c.tables("tm_test") == ["t"] and c.columns("tm_test.t") == [("id", "bigint"), ("name", "string")]
        assert spark.table("tm_test.t").count() == 1
        other = scratch(spark, "cat")
        df.unionByName(df).write.parquet(other)
        c.set_location("tm_test.t", other)
        assert c.location("tm_test.t").rstrip("/").endswith(other.rsplit("/", 1)[1]) and spark.table("tm_test.t").count() == 2
        c.drop_table("tm_test.t")
        assert not c.table_exists("tm_test.t")
    finally:
        c.drop_database("tm_test")
    with pytest.raises(ValueError):
        catalog.catalog_columns(T.StructType([T.StructField("a", T.ArrayType(T.IntegerType()))]))
    assert catalog.schema_name(" x ", "y") == "x" and catalog.schema_name(None, "y") == "y"


def test_generators_are_seeded_and_weighted(spark):
    orders = generators.orders(spark, 4000, 50, 200)
    assert orders.exceptAll(generators.orders(spark, 4000, 50, 200).repartition(7)).count() == 0
    assert orders.where("total_amount <> unit_price * quantity OR quantity NOT BETWEEN 1 AND 5 OR shipping_amount NOT BETWEEN 10 AND 60").count() == 0
    paid = generators.payments(orders)
    share = paid.where("status = 'PAID'").count() / paid.count()
    assert 0.70 < share < 0.80 and paid.where("status = 'PAID' AND paid_at IS NULL").count() == 0
    assert generators.reviews(orders).where("rating NOT BETWEEN 1 AND 5").count() == 0
    assert generators.shipments(orders).where("status = 'DELIVERED' AND delivered_at IS NULL").count() == 0
    assert generators.inventories(spark, 50).count() == 50 and generators.products(spark, 5).count() == 5
