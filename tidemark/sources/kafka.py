"""Kafka as a source and a sink (where the connector is installed), and its offsets."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def stream_options(servers: str, topics: Sequence[str], max_records: int = 100, max_delay: str = "300s", poll_cap: int | None = None, start: str = "earliest") -> dict[str, str]:
    """Options of a stream that fires at ``max_records`` new messages or ``max_delay``, whichever is first."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics),
        "startingOffsets": start,
        "minOffsetsPerTrigger": str(max_records),
        "maxTriggerDelay": max_delay,
        "maxOffsetsPerTrigger": str(poll_cap or 100 * max_records),
        "failOnDataLoss": "true",
        "kafka.session.timeout.ms": "45000",
        "kafka.request.timeout.ms": "60000",
        "kafka.max.partition.fetch.bytes": str(16 * 2**20),
    }


def read_stream(spark: SparkSession, servers: str, topics: Sequence[str], **kw) -> DataFrame:
    """topic, key, value, partition, offset, headers ...; offsets are committed with the query's checkpoint."""
    return spark.readStream.format("kafka").options(**stream_options(servers, topics, **kw)).load()


def read_batch(spark: SparkSession, servers: str, topics: Sequence[str], start: str = "earliest", end: str = "latest") -> DataFrame:
    return spark.read.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": start, "endingOffsets": end}).load()


def produce(df: DataFrame, servers: str, topic: str) -> None:
    """Write rows of key, value and headers."""
    df.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def lag(progress: dict | None) -> int | None:
    """Messages between the offsets a query has processed and the latest known; None without a query.

    A partition that has no processed offset yet counts from the earliest
    known, a fall of the latest counts as 0, and no partitions give 0.
    """
    if progress is None:
        return None
    total = 0
    for source in progress.get("sources", []):
        done, latest, start = (_offsets(source.get(k)) for k in ("endOffset", "latestOffset", "startOffset"))
        for key, high in latest.items():
            total += max(0, high - done.get(key, start.get(key, 0)))
    return total


def _offsets(value: str | dict | None) -> dict[tuple[str, str], int]:
    found = json.loads(value) if isinstance(value, str) and value.startswith("{") else value
    return {(t, p): o for t, parts in found.items() for p, o in parts.items()} if isinstance(found, dict) else {}
