"""History of changing entity attributes (problem 7).

Snapshots are co-partitioned and key-sorted: all are cut at the same range
borders of (entity, time), and each snapshot's part of a range is written as
one sorted run in the shared folder (``snap=<s>/part-<range>``). One task per
range then opens the k runs as iterators, merges them by (entity, time) with a
heap, and emits a version whenever the payload changes. It holds one row per
run and the version that is open, never a history. Because the borders may
fall inside an entity, an entity with a third of all rows is spread over many
tasks; the versions at the borders are stitched by a table of two rows per
range, whose size is bounded by the number of ranges.

Defined results: rows with a null entity or time have no place in a history
and are left out; of rows with equal entity and time the one last loaded
stands (null loads first, then the greatest payload); null payload values are values like any
other; an empty table gives an empty history; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from tidemark.functions.keys import micros
from tidemark.session import materialize, scratch

BATCH = 8192


def _sorted_runs(rows: DataFrame, path: str, ranges: int) -> None:
    """Write every snapshot as runs sorted by (entity, us, loaded), cut at common borders."""
    order = ["entity", "us", "loaded", *[c for c in rows.columns if c.startswith("v")]]
    cut = rows.repartitionByRange(ranges, "entity", "us")
    cut.sortWithinPartitions("snap", *order).write.partitionBy("snap").parquet(path)


def _run_files(spark, path: str) -> DataFrame:
    """(range, files): the runs of each range, from the file names."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.parquet").option("recursiveFileLookup", "true").load(path).select("path")
    number = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^part-(\d+)", 1).cast("int")
    return listed.groupBy(number.alias("range")).agg(F.sort_array(F.collect_list("path")).alias("files"))


def _open_run(path: str) -> Iterator[tuple]:
    fs, local = pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    with fs.open_input_file(local) as f:
        for batch in pq.ParquetFile(f).iter_batches(batch_size=BATCH):
            yield from zip(*[c.to_pylist() for c in batch.columns])


def _before(row: tuple) -> tuple:
    """Sort key (entity, time, load, payload) with nulls first."""
    return tuple((v is not None, v) for v in row)


def _merge(files: list[str]) -> Iterator[tuple]:
    """(entity, us, payload) of a range in order, the last loaded row of each entity and time."""
    merged = heapq.merge(*[_open_run(f) for f in files], key=_before)
    for (entity, us), same in groupby(merged, key=itemgetter(0, 1)):
        last = None
        for last in same:
            pass
        yield entity, us, last[3:]


def _versions(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Versions of each range; ``head`` marks the range's first, ``open`` the last of an entity in it."""
    buffer: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*buffer)) if buffer else [[] for _ in schema]
        buffer.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

    for batch in batches:
        for number, files in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            entity = start = payload = None
            head = True
            for e, us, values in _merge(files):
                if start is not None and e == entity and values == payload:
                    continue
                if start is not None:
                    buffer.append((number, entity, start, us if e == entity else None, head, e != entity, *payload))
                    head = False
                    if len(buffer) >= BATCH:
                        yield flush()
                entity, start, payload = e, us, values
            if start is not None:
                buffer.append((number, entity, start, None, head, True, *payload))
    yield flush()


def version_history(df: DataFrame, entity: Column, at: Column, loaded: Column, snapshot: Column, payload: dict[str, Column], deleted: Column | None = None, ranges: int | None = None) -> DataFrame:
    """(entity, valid_from_us, valid_to_us, <payload>), -1 for a version that is still valid.

    ``snapshot`` names the snapshot a row came with (few values); ``deleted``
    is a deletion time that, on any row, ends the entity's last version.
    ``ranges`` is the number of co-partitions (the shuffle setting by default).
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = [c.alias(f"v{i}") for i, c in enumerate(payload.values())]
    rows = df.select(snapshot.cast("string").alias("snap"), entity.alias("entity"), micros(at).alias("us"), micros(loaded).alias("loaded"), *values).where(F.col("entity").isNotNull() & F.col("us").isNotNull())
    path = scratch(spark, "runs")
    # Rows of a snapshot that repeat an entity and time are reduced before the range shuffle.
    names = [f"v{i}" for i in range(len(values))]
    best = F.max_by(F.struct("loaded", *names), F.struct("loaded", *names)).alias("best")
    once = rows.groupBy("snap", "entity", "us").agg(best).select("snap", "entity", "us", "best.*")
    _sorted_runs(once, path, ranges)
    kinds = ", ".join(f"v{i} {rows.schema[f'v{i}'].dataType.simpleString()}" for i in range(len(values)))
    ddl = f"range int, entity {rows.schema['entity'].dataType.simpleString()}, start long, stop long, head boolean, open boolean, {kinds}"
    out_schema = spark.createDataFrame([], ddl).schema
    arrow = to_arrow_schema(out_schema)
    if not rows.limit(1).count():
        raw = spark.createDataFrame([], out_schema)
    else:
        files = _run_files(spark, path).repartitionById(ranges, F.col("range"))
        raw = files.mapInArrow(lambda it: _versions(it, arrow), out_schema)
    raw = materialize(raw, "versions")
    stitched = _stitch(raw, len(values))
    if deleted is not None:
        ends = df.groupBy(entity.alias("entity")).agg(F.min(micros(deleted)).alias("gone"))
        stitched = stitched.join(ends, "entity", "left")
    else:
        stitched = stitched.withColumn("gone", F.lit(None).cast("long"))
    shown = [F.col(f"v{i}").alias(n) for i, n in enumerate(payload)]
    return stitched.select("entity", F.col("start").alias("valid_from_us"), F.coalesce("stop", "gone", F.lit(-1)).cast("long").alias("valid_to_us"), *shown)


def _stitch(raw: DataFrame, n_values: int) -> DataFrame:
    """Join what the range borders cut.

    The border table has the first version and the last one of each range: at
    most two rows per range, brought together in one small window. A head whose
    predecessor range ended with the same entity and payload continues that
    version and is dropped; an open version ends where the entity's next
    surviving version begins in a later range.
    """
    values = [f"v{i}" for i in range(n_values)]
    edge = F.struct("entity", *values)
    # Of each range: its first version; the last version; where its first version ends within the range.
    border = raw.groupBy("range").agg(F.min_by(F.struct("entity", "start", "stop", edge.alias("edge")), F.struct("entity", "start")).alias("first"), F.max_by(F.struct("entity", "start", edge.alias("edge")), F.struct("entity", "start")).alias("last"))
    before = Window.orderBy("range")
    marks = border.select("range", "first", "last", F.lag("last").over(before).alias("prev"))
    marks = marks.select("range", "first", "last", F.coalesce(F.col("prev.edge").eqNullSafe(F.col("first.edge")), F.lit(False)).alias("continues"))
    # The first point in a range at which a version of its first entity begins anew; null if the whole range continues.
    begins = F.when(~F.col("continues"), F.col("first.start")).otherwise(F.col("first.stop"))
    later = marks.select("range", "continues", F.col("first.entity").alias("first_entity"), F.col("last.entity").alias("last_entity"), begins.alias("begins"))
    after = Window.orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    # The next range that either begins a version of its first entity or belongs to another one.
    nxt = F.first(F.when(F.col("begins").isNotNull() | (F.col("first_entity") != F.col("last_entity")), F.struct("first_entity", "begins")), ignorenulls=True).over(after)
    following = later.select("range", "continues", F.col("last_entity"), nxt.alias("next"))
    joined = raw.join(following, "range")
    kept = joined.where(~(F.col("head") & F.col("continues")))
    carried = F.when(F.col("open") & F.col("stop").isNull() & (F.col("entity") == F.col("last_entity")) & (F.col("next.first_entity") == F.col("entity")), F.col("next.begins"))
    return kept.select("entity", "start", F.coalesce("stop", carried).alias("stop"), *values)
