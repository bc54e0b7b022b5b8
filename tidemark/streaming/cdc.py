"""Debezium change envelopes: decoding, and a stream into append-only Bronze.

Decoding is one ``from_json`` with a static schema per entity. Rows that are no
valid change keep their text in ``malformed`` and go to a quarantine table;
they never stop the stream. Bronze batches are written under their batch id, so
a batch that is tried again replaces itself: effectively once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidemark.sources.files import publish_json, read_json
from tidemark.sources.lake import SaveMode, VersionedTable

OPS = ("r", "c", "u", "d")
#: Operations without a row: truncate and message.
NO_ROW = ("t", "m")


def _wire_type(t: T.DataType) -> T.DataType:
    """How a column's values are written in the envelope."""
    if isinstance(t, T.TimestampType):
        return T.StringType()  # ISO 8601 with zone
    if isinstance(t, T.DateType):
        return T.IntegerType()  # days since 1970
    if isinstance(t, T.DecimalType):
        return T.DoubleType()  # the connector sends doubles
    return t


def envelope_schema(row: T.StructType) -> T.StructType:
    wire = T.StructType([T.StructField(f.name, _wire_type(f.dataType)) for f in row.fields])
    source = T.StructType([T.StructField("table", T.StringType()), T.StructField("ts_ms", T.LongType())])
    payload = T.StructType([T.StructField("op", T.StringType()), T.StructField("source", source), T.StructField("after", wire), T.StructField("before", wire)])
    return T.StructType([T.StructField("payload", payload), T.StructField("_unread", T.StringType())])


def to_scale(value: Column, scale: int, precision: int) -> Column:
    """A double as a decimal of its column's scale; null stays null."""
    return value.cast(T.DecimalType(precision, scale))


def _logical(value: Column, t: T.DataType) -> Column:
    if isinstance(t, T.TimestampType):
        return F.try_to_timestamp(value)
    if isinstance(t, T.DateType):
        return F.date_add(F.to_date(F.lit("1970-01-01")), value)
    if isinstance(t, T.DecimalType):
        return to_scale(value, t.scale, t.precision)
    return value


def decode(messages: DataFrame, row: T.StructType, value: str = "value") -> DataFrame:
    """entity, op, source_ts_ms, record (struct or null), malformed (text or null).

    The row image is ``after``, else ``before``; with neither, record and
    source_ts_ms are null. Malformed: no JSON, or without payload, one of the
    known operations, table, or time of a row, or with a field that is not of its type.
    """
    text = F.col(value).cast("string")
    parsed = messages.withColumn("e", F.from_json(text, envelope_schema(row), {"columnNameOfCorruptRecord": "_unread"}))
    image = F.coalesce("e.payload.after", "e.payload.before")
    ok = F.col("e._unread").isNull() & F.col("e.payload.op").isin(*OPS, *NO_ROW) & F.col("e.payload.source.table").isNotNull() & (image.isNull() | F.col("e.payload.source.ts_ms").isNotNull())
    valid = F.coalesce(ok, F.lit(False))
    record = F.when(valid & image.isNotNull(), F.struct(*[_logical(image.getField(f.name), f.dataType).alias(f.name) for f in row.fields]))
    return parsed.select(
        F.when(valid, F.col("e.payload.source.table")).alias("entity"),
        F.when(valid, F.col("e.payload.op")).alias("op"),
        F.when(valid & image.isNotNull(), F.col("e.payload.source.ts_ms")).alias("source_ts_ms"),
        record.alias("record"),
        F.when(~valid, text).alias("malformed"),
    )


def bronze_rows(decoded: DataFrame, with_op: bool = True) -> DataFrame:
    """Flat rows with ``_cdc_ts_ms`` (and ``_cdc_op``); changes without a row image are left out."""
    extra = [F.col("op").alias("_cdc_op")] if with_op else []
    return decoded.where(F.col("record").isNotNull()).select("record.*", F.col("source_ts_ms").alias("_cdc_ts_ms"), *extra)


def encode(df: DataFrame, row: T.StructType, entity: str, op: Column, ts_ms: Column) -> DataFrame:
    """``value``: rows as envelopes, deletes with the image before only (a fixture writer)."""
    def wire(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return F.unix_date(c).alias(f.name)
        return (c.cast("double") if isinstance(f.dataType, T.DecimalType) else c).alias(f.name)

    image = F.struct(*[wire(f) for f in row.fields])
    payload = F.struct(op.alias("op"), F.struct(F.lit(entity).alias("table"), ts_ms.alias("ts_ms")).alias("source"), F.when(op != "d", image).alias("after"), F.when(op == "d", image).alias("before"))
    return df.select(F.to_json(F.struct(payload.alias("payload"))).alias("value"))


def append_batch(path: str, row: T.StructType, observe: Callable[[str, int, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: Bronze rows and malformed texts of a batch, each under the batch's id."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        decoded = decode(batch, row).persist()
        try:
            VersionedTable(spark, f"{path}/bronze").write(bronze_rows(decoded), SaveMode.APPEND, key=f"{number:012d}")
            VersionedTable(spark, f"{path}/quarantine").write(decoded.where(F.col("malformed").isNotNull()).select("malformed"), SaveMode.APPEND, key=f"{number:012d}")
        finally:
            decoded.unpersist()

    return write


def start_bronze(stream: DataFrame, row: T.StructType, path: str, every: str | None = None) -> StreamingQuery:
    """Run the stream into ``path``; without ``every`` (``300 seconds``) it takes what is there and ends."""
    writer = stream.writeStream.foreachBatch(append_batch(path, row)).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder of envelope lines as a stream."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


class ChangeWatch:
    """Fires when a counter is not what it was at the last firing (a reset fires too); remembered in a file."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def fires(self, value: float | None) -> bool:
        if value is None or (read_json(self.path) or {}).get("value") == value:
            return False
        publish_json(self.spark, self.path, {"value": value})
        return True


class StreamMetrics(StreamingQueryListener):
    """A row per micro-batch: rows in, seconds, lag; failures by query."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.failures: list[dict] = []

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        from tidemark.sources.kafka import lag

        p = json.loads(event.progress.json)
        self.rows.append({"query": p.get("name"), "batch": p["batchId"], "ts": p["timestamp"], "rows_in": sum(s.get("numInputRows", 0) for s in p.get("sources", [])), "seconds": p.get("durationMs", {}).get("triggerExecution", 0) / 1000, "lag": lag(p)})

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failures.append({"query": str(event.id), "error": event.exception})


def run_entities(jobs: dict[str, Callable[[], StreamingQuery]], at_once: int = 8) -> dict[str, str | None]:
    """Run one query per entity, ``at_once`` side by side, to their ends; the error of each, if any."""
    from concurrent.futures import ThreadPoolExecutor

    def run(start: Callable[[], StreamingQuery]) -> str | None:
        try:
            start().awaitTermination()
        except Exception as e:  # noqa: BLE001
            return str(e).splitlines()[0]
        return None

    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(jobs, pool.map(run, jobs.values())))
