"""Applying a stream of inserts, updates and deletes (problem 4).

Changes are spread over hash buckets of their key. In each bucket an embedded
DuckDB table keyed by the row key takes them with a conditional upsert: a
conflict replaces the stored row only if the incoming sequence is greater.
Deletes are stored as tombstones with their sequence, so an older change that
arrives later cannot revive a row. Each bucket is exported to a new file. Files
are named by manifests of ``GROUP`` buckets each, which tasks write, and those by one
version that is published in one step, so readers see all buckets of a version
or none, and of two writers at once one is refused. The driver holds one row per group.

The same upsert first runs over each input partition (the operation is
associative and idempotent), so a key with a third of all changes is down to
one row per partition before the shuffle. Repeated and out-of-order changes
and repeated runs give the same state. Task attempts write files of their own;
only those named by successful tasks reach a manifest.

Buckets are sized by bytes: a new table has as many as its first feed needs,
and when they have grown past ``BUCKET_BYTES`` their number doubles, each half
reading its own rows of the old bucket. A task hands on its partial state at
``PARTIAL_BYTES``; what still outgrows the memory of the embedded table is
spilled to the executor's own spill space, as Spark's own operators do.

Defined results: a change without key, with a null or unknown operation or an incomplete
record counts for nothing; a null time or position is older than any; at equal
sequence a delete wins over a set, and then the greater record; an empty feed
leaves the state as it is.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import duckdb
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.files import open_fs, publish_version, read_json, read_version

OLDEST = -(2**63)
#: Rows and bytes a partial upsert takes before it hands its state on.
PARTIAL_ROWS = 200_000
PARTIAL_BYTES = 64 * 2**20
#: Rows and bytes of a bucket beyond which there are more of them.
BUCKET_ROWS = 250_000
BUCKET_BYTES = 64 * 2**20
#: Bytes a row has besides its payload, about.
ROW_BYTES = 150
#: Rows and bytes upserted at once.
CHUNK_ROWS, CHUNK_BYTES = 50_000, 16 * 2**20
#: Buckets of one manifest.
GROUP = 256

STATE = "source string, entity string, row_key string, ts long, seq long, dead boolean"

_UPSERT = """
INSERT INTO state
SELECT source, entity, row_key, r.ts, r.seq, r.dead, r.payload, slot FROM (
  SELECT source, entity, row_key, slot, max({'ts': ts, 'seq': seq, 'dead': dead, 'payload': coalesce(payload, '')}) AS r FROM batch WHERE row_key IS NOT NULL GROUP BY ALL)
ON CONFLICT (source, entity, row_key) DO UPDATE SET ts = excluded.ts, seq = excluded.seq, dead = excluded.dead, payload = excluded.payload
WHERE (excluded.ts, excluded.seq, excluded.dead, excluded.payload) > (state.ts, state.seq, state.dead, state.payload)
"""


class _State:
    """The embedded table of one bucket."""

    def __init__(self) -> None:
        local = (os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("LOCAL_DIRS") or tempfile.gettempdir()).split(",")[0]
        self.spill = os.path.join(local, f"upsert-{uuid.uuid4().hex}")
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": self.spill, "preserve_insertion_order": False})
        self.clear()

    def clear(self) -> None:
        self.con.execute("CREATE OR REPLACE TABLE state (source VARCHAR, entity VARCHAR, row_key VARCHAR, ts BIGINT, seq BIGINT, dead BOOLEAN, payload VARCHAR, slot BIGINT, PRIMARY KEY (source, entity, row_key))")

    def upsert(self, batches: list[pa.RecordBatch]) -> None:
        self.con.register("batch", pa.Table.from_batches(batches))
        self.con.execute(_UPSERT)
        self.con.unregister("batch")

    def size(self) -> tuple[int, int]:
        """Rows, and bytes of their payloads."""
        return self.con.execute("SELECT count(*), coalesce(sum(strlen(payload)), 0) FROM state").fetchall()[0]

    def export(self, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
        for b in self.con.sql("SELECT source, entity, row_key, ts, seq, dead, payload, slot FROM state").to_arrow_reader(rows):
            yield b.cast(_ARROW)

    def close(self) -> None:
        self.con.close()
        shutil.rmtree(self.spill, ignore_errors=True)


_FIELDS = [("source", pa.string()), ("entity", pa.string()), ("row_key", pa.string()), ("ts", pa.int64()), ("seq", pa.int64()), ("dead", pa.bool_()), ("payload", pa.string()), ("slot", pa.int64())]
_ARROW = pa.schema(_FIELDS)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, rows, size = [], 0, 0
    for b in batches:
        # A batch of large records is cut.
        step = max(1, min(b.num_rows, CHUNK_BYTES * b.num_rows // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            held.append(part)
            rows, size = rows + part.num_rows, size + part.nbytes
            if rows >= CHUNK_ROWS or size >= CHUNK_BYTES:
                yield held
                held, rows, size = [], 0, 0
    if held:
        yield held


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state of an input partition, handed on whenever it grows past PARTIAL_ROWS or PARTIAL_BYTES."""
    state = _State()
    try:
        for held in _chunks(batches):
            state.upsert(held)
            rows, size = state.size()
            if rows >= PARTIAL_ROWS or size >= PARTIAL_BYTES:
                yield from state.export()
                state.clear()
        yield from state.export()
    finally:
        state.close()


def _stored(groups: dict[int, str], number: int, each: int) -> str | None:
    """The file of a bucket, from its group's manifest."""
    uri = groups.get(number // each)
    found = (read_json(uri) or {}).get(str(number)) if uri else None
    return found[0] if found else None


def _bucket(batches: Iterator[pa.RecordBatch], groups: dict[int, str], before: int, buckets: int, folder: str, each: int = GROUP) -> Iterator[pa.RecordBatch]:
    """Apply a bucket's changes to its stored state and export it; one manifest row."""
    state, number = _State(), None
    try:
        for held in _chunks(batches):
            if number is None:
                number = held[0].column("bucket")[0].as_py()
                # After a split, the bucket's rows are in the one it was half of.
                stored = _stored(groups, number % before, each) if before else None
                if stored:
                    fs, path = open_fs(stored)
                    with fs.open_input_file(path) as f:
                        for part in _chunks(pq.ParquetFile(f).iter_batches(batch_size=CHUNK_ROWS)):
                            state.upsert(part if before == buckets else [b.filter(pa.compute.equal(_modulo(b.column("slot"), buckets), number)) for b in part])
            state.upsert([b.drop_columns(["bucket"]) for b in held])
        if number is None:
            return
        uri = f"{folder}/bucket-{number:06d}-{uuid.uuid4().hex}.parquet"
        fs, path = open_fs(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        rows, size = state.size()
        with fs.open_output_stream(path) as out, pq.ParquetWriter(out, _ARROW, compression="zstd") as writer:
            for b in state.export():
                writer.write_batch(b)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([number], pa.int32()), "file": [uri], "bytes": pa.array([size + ROW_BYTES * rows], pa.int64())})
    finally:
        state.close()


def _modulo(slots: pa.Array, n: int) -> pa.Array:
    return pa.array(slots.to_numpy(zero_copy_only=False) % n, pa.int64())


def _group(batches: Iterator[pa.RecordBatch], groups: dict[int, str], fresh: bool, folder: str, each: int) -> Iterator[pa.RecordBatch]:
    """Write the manifest of a group's buckets; those without changes keep their files unless all are ``fresh``."""
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return
    number = rows[0]["bucket"] // each
    held = {} if fresh or number not in groups else read_json(groups[number]) or {}
    held.update({str(r["bucket"]): [r["file"], r["bytes"]] for r in rows})
    uri = f"{folder}/group-{number:06d}-{uuid.uuid4().hex}.json"
    fs, path = open_fs(uri)
    with fs.open_output_stream(path) as f:
        f.write(json.dumps(held).encode())
    yield pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int32()), "uri": [uri], "bytes": pa.array([sum(b for _, b in held.values())], pa.int64())})


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri in b.column(0).to_pylist():
            yield pa.RecordBatch.from_pydict({"file": [f for f, _ in (read_json(uri) or {}).values()]})


def _read(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri in b.column(0).to_pylist():
            fs, path = open_fs(uri)
            with fs.open_input_file(path) as f:
                yield from pq.ParquetFile(f).iter_batches(batch_size=20_000, columns=columns)


def normalize_changes(df: DataFrame, payload: bool) -> DataFrame:
    """(source, entity, row_key, ts, seq, dead, payload) of the changes that count.

    ``df``: source_db, entity, op, source_ts_ms, lsn, record and what
    ``changes.with_row_key`` adds.
    """
    counted = df.where(F.col("op").isin("r", "c", "u", "d") & F.col("complete") & F.col("row_key").isNotNull())
    dead = F.col("op") == "d"
    body = F.when(dead, "").otherwise(F.col("record")) if payload else F.lit("")
    return counted.select(F.coalesce("source_db", F.lit("")).alias("source"), F.coalesce("entity", F.lit("")).alias("entity"), "row_key", F.coalesce("source_ts_ms", F.lit(OLDEST)).cast("long").alias("ts"), F.coalesce("lsn", F.lit(OLDEST)).cast("long").alias("seq"), dead.alias("dead"), body.alias("payload"))


class UpsertTable:
    """A table in the shared folder that change feeds are applied to."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path, self.first = spark, path, buckets
        self.current = read_version(path) or {"version": 0, "buckets": 0, "groups": {}}

    def _wanted(self, rows: int, size: int) -> int:
        """Buckets to have now: those of the first feed, then doubled while they are too large."""
        stored = sum(b for _, b in self.current["groups"].values())
        wanted = max(-(-rows // BUCKET_ROWS), -(-(size + stored) // BUCKET_BYTES))
        buckets = self.current["buckets"]
        if not buckets:
            return max(self.first or int(self.spark.conf.get("spark.sql.shuffle.partitions")), wanted if self.first is None else 1)
        while wanted > 2 * buckets:
            buckets *= 2
        return buckets

    def apply(self, changes: DataFrame, total: int | None = None, size: int | None = None) -> int:
        """Apply ``normalize_changes`` rows; returns the version now published.

        ``total`` and ``size`` are the number of changes and the bytes of their
        payloads, if known; they set the number of buckets.
        """
        spark = self.spark
        if total is None or size is None:
            total, size = changes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).first()
        before, buckets = self.current["buckets"], self._wanted(total, size + ROW_BYTES * total)
        version = self.current["version"] + 1
        folder = f"{self.path}/v{version}-{uuid.uuid4().hex[:8]}"
        groups = {int(k): uri for k, (uri, _) in self.current["groups"].items()}
        slotted = changes.withColumn("slot", F.pmod(F.xxhash64("source", "entity", "row_key"), F.lit(2**40)))
        reduced = slotted.mapInArrow(_partial, f"{STATE}, payload string, slot long")
        placed = reduced.withColumn("bucket", F.pmod("slot", F.lit(buckets)).cast("int"))
        split, each = bool(before) and buckets != before, GROUP
        if split:
            # Every bucket takes its rows over.
            empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in reduced.schema]
            placed = placed.unionByName(spark.range(buckets).select(*empty, F.col("id").cast("int").alias("bucket")))
        done = placed.repartitionById(buckets, F.col("bucket")).mapInArrow(lambda it: _bucket(it, groups, before, buckets, folder, each), "bucket int, file string, bytes long")
        number = F.floor(F.col("bucket") / each).cast("int")
        named = done.repartitionById(-(-buckets // each), number).mapInArrow(lambda it: _group(it, groups, split, folder, each), "number int, uri string, bytes long")
        # One row per group of buckets.
        kept = {} if split else dict(self.current["groups"])
        state = {"version": version, "buckets": buckets, "groups": kept | {str(r[0]): [r[1], r[2]] for r in named.collect()}}
        publish_version(spark, self.path, state)
        self.current = state
        return version

    def rows(self, tombstones: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
        """The published state: source, entity, row_key, ts, seq, dead, payload, or some of these."""
        schema = StructType.fromDDL(f"{STATE}, payload string")
        wanted = list(columns or schema.names)
        uris = [(uri,) for uri, _ in self.current["groups"].values()]
        if not uris:
            return self.spark.createDataFrame([], schema).select(*wanted)
        read = wanted if tombstones or "dead" in wanted else [*wanted, "dead"]
        tasks = min(self.current["buckets"], 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        files = self.spark.createDataFrame(uris, "uri string").mapInArrow(_files, "file string").repartition(tasks)
        found = files.mapInArrow(lambda it: _read(it, read), StructType([schema[c] for c in read]))
        return (found if tombstones else found.where(~F.col("dead"))).select(*wanted)
