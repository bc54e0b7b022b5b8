import datetime as dt
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import metrics
from tidemark.session import scratch
from tidemark.sources.lake import VersionedTable
from tidemark.streaming import cdc

ROW = T.StructType([T.StructField("id", T.StringType()), T.StructField("total", T.DecimalType(10, 2)), T.StructField("paid", T.BooleanType()), T.StructField("updated_at", T.TimestampType()), T.StructField("born", T.DateType())])


def message(op="c", after=None, before=None, ts=1785607968684, table="orders", **drop):
    return json.dumps({"schema": {}, "payload": {"op": op, "source": {"table": table, "ts_ms": ts}, "after": after, "before": before}})


def decoded(spark, *texts):
    return cdc.decode(spark.createDataFrame([(t,) for t in texts], "value string"), ROW).collect()


def test_images_and_logical_types(spark):
    image = {"id": "a", "total": 42.5, "paid": True, "updated_at": "2026-08-04T12:30:00Z", "born": 19584}
    for op, kw in (("c", {"after": image}), ("r", {"after": image}), ("d", {"before": image})):
        (r,) = decoded(spark, message(op, **kw))
        assert (r.entity, r.op, r.source_ts_ms, r.malformed) == ("orders", op, 1785607968684, None)
        assert (r.record.id, str(r.record.total), r.record.paid, r.record.born) == ("a", "42.50", True, dt.date(2023, 8, 15))
    (r,) = decoded(spark, message("u", after={"id": "a", "updated_at": None, "total": 19.999}))
    assert r.record.updated_at is None and str(r.record.total) == "20.00"


def test_no_image_and_malformed(spark):
    (r,) = decoded(spark, message("t"))
    assert r.record is None and r.source_ts_ms is None and r.malformed is None
    for bad in ("{", "{}", '{"payload": {}}', message(None, after={"id": "a"}), message("c", after={"id": "a"}, ts=None), message("c", after={"id": "a"}, table=None)):
        (r,) = decoded(spark, bad)
        assert r.malformed == bad and r.record is None
    assert decoded(spark) == []


def test_stream_is_effectively_once(spark):
    path = scratch(spark, "stream")
    write = cdc.append_batch(path, ROW)
    batch = spark.createDataFrame([(message(after={"id": f"o{i}", "total": 1.0}),) for i in range(100)] + [("bad",)], "value string")
    write(batch, 0)
    write(batch, 0)  # the same batch once more, as after a failure
    write(batch, 1)
    assert VersionedTable(spark, f"{path}/bronze").read().count() == 200
    assert VersionedTable(spark, f"{path}/quarantine").read().count() == 2


def test_stream_of_files_continues_from_its_checkpoint(spark):
    path = scratch(spark, "stream")
    for n in range(2):
        spark.createDataFrame([(message(after={"id": f"{n}-{i}"}),) for i in range(10)], "value string").write.mode("append").text(f"{path}/in")
        cdc.start_bronze(cdc.read_lines(spark, f"{path}/in"), ROW, f"{path}/out").awaitTermination()
    rows = VersionedTable(spark, f"{path}/out/bronze").read()
    assert rows.count() == 20 and rows.select("id").distinct().count() == 20 and "_cdc_ts_ms" in rows.columns


def test_change_watch(spark):
    w = cdc.ChangeWatch(spark, scratch(spark, "watch") + "/mark")
    assert [w.fires(v) for v in (None, 5.0, 5.0, 7.0, 2.0, 2.0)] == [False, True, False, True, True, False]


def test_unknown_operations_and_wrong_types_are_malformed(spark):
    row = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    envelope = '{{"payload": {{"op": "{}", "source": {{"table": "t", "ts_ms": 5}}, "after": {{"id": {}, "name": "a"}}}}}}'
    texts = [envelope.format(*x) for x in (("c", 1), ("x", 2), ("u", '"three"'), ("d", 4))]
    got = cdc.decode(spark.createDataFrame([(t,) for t in texts], "value string"), row).collect()
    assert [r.malformed for r in got] == [None, texts[1], texts[2], None]


def test_alerts_that_last(spark):
    rows = [("a", 0, 9), ("a", 60, 9), ("a", 300, 9), ("b", 0, 9), ("b", 200, 1), ("b", 290, 9), ("c", 250, 9), ("d", 0, 9)]
    df = spark.createDataFrame(rows, "s string, at long, v long").withColumn("ts", F.timestamp_seconds("at"))
    got = metrics.lasting(df, ["s"], "ts", F.col("v") > 5, F.timestamp_seconds(F.lit(301)), 240).select("s", F.unix_seconds("since").alias("since")).collect()
    assert [(r.s, r.since) for r in got] == [("a", 0)]
