"""Queries of change envelopes, streams, reconciliation and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import cdc_apply, metrics, standardize
from tidemark.plans.marketplace import _changes
from tidemark.session import scratch
from tidemark.sources import lake
from tidemark.sources.tables import table
from tidemark.streaming import cdc

EVENT_ROW = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DecimalType(12, 2)), T.StructField("ts", T.TimestampType()), T.StructField("day", T.DateType())])
#: Lines no decoder accepts, beside the good ones.
BROKEN = ("{not json", '{"schema": {}}', '{"payload": {"op": "c", "source": {"ts_ms": 1}}}')


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """The events as envelopes: clicks created, errors deleted, others updated; some broken lines."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("value").cast("decimal(12,2)").alias("value"), F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("day"))
    op = F.when(F.col("event_type") == "error", "d").when(F.col("event_type") == "click", "c").otherwise("u")
    good = cdc.encode(events, EVENT_ROW, "events", op, F.unix_millis("ts"))
    return good.unionByName(spark.createDataFrame([(b,) for b in BROKEN], "value string"))


def _micros(df: DataFrame) -> DataFrame:
    return df.withColumn("ts_us", F.unix_micros("ts")).drop("ts")


def cdc_decode(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes decoded to rows with their provenance."""
    return _micros(cdc.bronze_rows(cdc.decode(_messages(spark, d), EVENT_ROW)))


def cdc_malformed(spark: SparkSession, d: str) -> DataFrame:
    """What the decoder sets aside."""
    return cdc.decode(_messages(spark, d), EVENT_ROW).where(F.col("malformed").isNotNull()).select("malformed")


def cdc_latest_state(spark: SparkSession, d: str) -> DataFrame:
    """The last change of each user, deletes not shown."""
    rows = cdc_decode(spark, d)
    last = standardize.latest_by_key(rows, ["user_id"], "_cdc_ts_ms", ["event_id"])
    return last.where(F.col("_cdc_op") != "d").select("user_id", "event_id", "event_type", "_cdc_ts_ms")


def cdc_stream_bronze(spark: SparkSession, d: str) -> DataFrame:
    """The same rows through a stream of files into Bronze."""
    path = scratch(spark, "stream")
    _messages(spark, d).write.text(f"{path}/in")
    query = cdc.start_bronze(cdc.read_lines(spark, f"{path}/in"), EVENT_ROW, f"{path}/out")
    query.awaitTermination()
    return _micros(lake.VersionedTable(spark, f"{path}/out/bronze").read())


def cdc_incremental_apply(spark: SparkSession, d: str) -> DataFrame:
    """The state after the feed is applied in two deliveries, the later half of the log first."""
    changes = cdc_apply.normalize_changes(_changes(spark, d), payload=False)
    target = cdc_apply.UpsertTable(spark, scratch(spark, "upsert"))
    odd = F.pmod(F.xxhash64("seq"), F.lit(2)) == 1
    target.apply(changes.where(odd))
    target.apply(changes.where(~odd))
    return target.rows().select(F.col("source").alias("source_db"), "entity", "row_key", F.col("seq").alias("lsn"))


def raw_reconcile_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each source table and of its landed copy."""
    root, rows = scratch(spark, "raw"), []
    for name in ("region", "nation", "supplier", "customer"):
        source = table(spark, d, name)
        lake.land_raw(source, root, name)
        rows.append((name, source.count(), lake.read_raw(spark, f"{root}/raw/{name}").count()))
    return spark.createDataFrame(rows, "table_name string, source_rows long, landed_rows long")


def bronze_compact(spark: SparkSession, d: str) -> DataFrame:
    """A table of many small files, compacted: the same rows."""
    target = lake.VersionedTable(spark, scratch(spark, "compact"))
    target.write(table(spark, d, "customer").repartition(12))
    target.compact()
    return target.read()


# --- Metric queries over event samples ------------------------------------------------------------


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value"))


def _end(spark: SparkSession, d: str):
    return F.lit(table(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0])


def metric_increase(spark: SparkSession, d: str) -> DataFrame:
    """Growth of a counter (the event id) per type over the last ten days."""
    return metrics.increase(_samples(spark, d), ["event_type"], "ts", "event_id", _end(spark, d), 864_000).withColumn("increase", F.col("increase").cast("double"))


def metric_rate(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rate(_samples(spark, d), ["event_type"], "ts", "event_id", _end(spark, d), 864_000)


def metric_latest(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latest(_samples(spark, d), ["event_type"], "ts", "event_id")


def metric_staleness(spark: SparkSession, d: str) -> DataFrame:
    return metrics.staleness(_samples(spark, d), ["event_type"], "ts", F.lit("2027-01-01 00:00:00").cast("timestamp"))


BOUNDS = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0)


def metric_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(_samples(spark, d), ["event_type"], "value", BOUNDS)


def metric_quantile(spark: SparkSession, d: str) -> DataFrame:
    """The 0.95 quantile of values, interpolated in buckets."""
    return metrics.histogram_quantile(metric_histogram(spark, d), ["event_type"], 0.95)


def metric_sum_by(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).groupBy("event_type").agg(F.sum(F.col("value").cast("decimal(19,4)")).cast("decimal(38,4)").alias("total"))


def metric_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Types with any error in the last ten days."""
    return metrics.alerts(metric_increase(spark, d), (F.col("increase") > 0) & (F.col("event_type") == "error"), "errors_seen").select("event_type", "alert")


QUERIES = {f.__name__: f for f in (cdc_decode, cdc_malformed, cdc_latest_state, cdc_stream_bronze, cdc_incremental_apply, raw_reconcile_counts, bronze_compact, metric_increase, metric_rate, metric_latest, metric_staleness, metric_histogram, metric_quantile, metric_sum_by, metric_alerts)}

# --- SQL ----------------------------------------------------------------------------------------------

_DECODED = """SELECT event_id, user_id, event_type, CAST(value AS DECIMAL(12,2)) AS value, CAST(ts AS DATE) AS day, epoch_us(ts) AS ts_us, epoch_us(ts) // 1000 AS _cdc_ts_ms,
CASE event_type WHEN 'error' THEN 'd' WHEN 'click' THEN 'c' ELSE 'u' END AS _cdc_op FROM events"""
_RECENT = """WITH recent AS (SELECT event_type, ts, event_id, lag(event_id) OVER (PARTITION BY event_type ORDER BY ts) AS before FROM events
WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 864000 SECOND),
grown AS (SELECT event_type, CAST(sum(CASE WHEN before IS NULL THEN 0 WHEN event_id < before THEN event_id ELSE event_id - before END) AS DOUBLE) AS increase FROM recent GROUP BY 1) """
_BUCKETS = " UNION ALL ".join(f"SELECT event_type, CAST({b} AS DOUBLE) AS le, count(*) FILTER (value <= {b}) AS count FROM events GROUP BY 1" for b in BOUNDS) + " UNION ALL SELECT event_type, CAST('infinity' AS DOUBLE), count(value) FROM events GROUP BY 1"

ORACLES = {
    "cdc_decode": _DECODED,
    "cdc_malformed": "SELECT * FROM (VALUES " + ", ".join(f"('{b}')" for b in BROKEN) + ") t(malformed)",
    "cdc_latest_state": f"SELECT user_id, event_id, event_type, _cdc_ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY _cdc_ts_ms DESC, event_id DESC) AS rn FROM ({_DECODED})) WHERE rn = 1 AND _cdc_op <> 'd'",
    "cdc_stream_bronze": _DECODED,
    "raw_reconcile_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS source_rows, count(*) AS landed_rows FROM {t}" for t in ("region", "nation", "supplier", "customer")),
    "bronze_compact": "SELECT * FROM customer",
    "metric_increase": _RECENT + "SELECT * FROM grown",
    "metric_rate": _RECENT + "SELECT event_type, increase / 864000 AS rate FROM grown",
    "metric_latest": "SELECT event_type, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1",
    "metric_staleness": "SELECT event_type, date_sub('second', max(ts), TIMESTAMP '2027-01-01') AS seconds FROM events GROUP BY 1",
    "metric_histogram": _BUCKETS,
    "metric_quantile": f"""WITH b AS ({_BUCKETS}), s AS (
  SELECT *, coalesce(lag(count) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS low, 0.95 * max(count) OVER (PARTITION BY event_type) AS rank FROM b WINDOW w AS (PARTITION BY event_type ORDER BY le))
SELECT event_type, arg_min(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (rank - below) / greatest(count - below, 1) END, le) AS quantile FROM s WHERE count >= rank GROUP BY 1""",
    "metric_sum_by": "SELECT event_type, CAST(sum(CAST(value AS DECIMAL(19,4))) AS DECIMAL(38,4)) AS total FROM events GROUP BY 1",
    "metric_alerts": _RECENT + "SELECT event_type, 'errors_seen' AS alert FROM grown WHERE increase > 0 AND event_type = 'error'",
}
