"""Messages delivered more than once (problem 5).

The identifiers seen so far are kept in the shared folder as sorted arrays,
split by hash prefix into partitions that a task can hold. An incoming batch
is reduced within each Arrow batch first (of copies side by side only the
earliest goes on, so an identifier with a third of all rows is no hot group),
then its candidates meet the index of their prefix: each is looked up in the
sorted runs by binary search, those not found are deduplicated among
themselves, and the novel identifiers become a new immutable run. When a
prefix has ``MAX_RUNS`` runs the next one is merged with them into one. The runs of a
version are published in one step, so a batch is in the index
wholly or not at all, a repeated task changes nothing, and of two writers at
once one is refused.

Prefixes split as the index grows: when they hold more than ``PREFIX_IDS``
identifiers on average their number doubles. Both halves of a prefix share its
immutable runs (a binary search does not mind what else is in them), and each
keeps its own part when it merges.

Identifiers are 128-bit hashes of the identifying columns (two independent
64-bit hashes): at 10^12 messages the chance that any two differ but collide
is under 10^-14.

Defined results: nulls in identifying columns are equal to one another and
differ from blanks; of several rows with one identifier in a batch the one
smallest in ``order`` is new (nulls last), of batches the first; an empty
batch changes nothing.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize
from tidemark.sources.files import open_fs, publish_version, read_version

MAX_RUNS = 4
#: Identifiers of a prefix (16 bytes each) beyond which prefixes split.
PREFIX_IDS = 4_000_000
_OUT = "row_id long, repeated boolean, prefix int, file string, keeps string, ids long"
_ARROW = pa.schema([("row_id", pa.int64()), ("repeated", pa.bool_()), ("prefix", pa.int32()), ("file", pa.string()), ("keeps", pa.string()), ("ids", pa.int64())])


def _first_of_each(hi: np.ndarray, lo: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (hi, lo, rank), and a mask of the first of each identifier in that order."""
    order = np.lexsort((rank, lo, hi))
    h, l = hi[order], lo[order]
    first = np.ones(len(order), bool)
    first[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
    return order, first


def _local(batches: Iterator[pa.RecordBatch], prefixes: int) -> Iterator[pa.RecordBatch]:
    """Candidates and certain repeats; repeats are spread evenly over the partitions."""
    for b in batches:
        hi, lo, row = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        order, first = _first_of_each(hi, lo, row)
        hi, lo, row = hi[order], lo[order], row[order]
        prefix = np.where(first, hi.view(np.uint64) % prefixes, row.view(np.uint64) % prefixes).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(row), pa.array(~first), pa.array(prefix)], ["hi", "lo", "row_id", "repeated", "prefix"])


def _seen(runs: list[tuple[np.ndarray, np.ndarray]], hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Which identifiers are in one of the sorted runs, by binary search."""
    found = np.zeros(len(hi), bool)
    for run_hi, run_lo in runs:
        left = np.searchsorted(run_hi, hi, "left")
        right = np.searchsorted(run_hi, hi, "right")
        for step in range(int((right - left).max(initial=0))):
            at = left + step
            live = np.flatnonzero(at < right)
            found[live] |= run_lo[at[live]] == lo[live]
    return found


def _load(uri: str) -> tuple[np.ndarray, np.ndarray]:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        ids = np.load(io.BytesIO(f.read()), allow_pickle=False)
    return ids[0], ids[1]


def _save(folder: str, prefix: int, hi: np.ndarray, lo: np.ndarray) -> str:
    uri = f"{folder}/prefix-{prefix:06d}-{uuid.uuid4().hex}.npy"
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    body = io.BytesIO()
    np.save(body, np.stack([hi, lo]), allow_pickle=False)
    with fs.open_output_stream(path) as f:
        f.write(body.getbuffer())
    return uri


def _rows(row_ids: np.ndarray, repeated: bool) -> pa.RecordBatch:
    n = len(row_ids)
    return pa.RecordBatch.from_arrays([pa.array(row_ids, pa.int64()), pa.array(np.full(n, repeated)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], schema=_ARROW)


def _against_index(batches: Iterator[pa.RecordBatch], index: dict[int, list[str]], prefixes: int, folder: str) -> Iterator[pa.RecordBatch]:
    """Flag the rows of one prefix, write its novel identifiers, and name its runs."""
    held, prefix = [], None
    for b in batches:
        repeated = b.column("repeated").to_numpy(zero_copy_only=False)
        row = b.column("row_id").to_numpy(zero_copy_only=False)
        if repeated.any():
            yield _rows(row[repeated], True)
        if b.num_rows:
            prefix = b.column("prefix")[0].as_py()
        held.append((b.column("hi").to_numpy()[~repeated], b.column("lo").to_numpy()[~repeated], row[~repeated]))
    if prefix is None:
        return
    hi, lo, row = (np.concatenate(c) for c in zip(*held))
    order, first = _first_of_each(hi, lo, row)
    hi, lo, row = hi[order], lo[order], row[order]
    files = index.get(prefix, [])
    runs = [_load(f) for f in files]
    new = first & ~_seen(runs, hi, lo)
    yield _rows(row[~new], True)
    yield _rows(row[new], False)
    if not new.any():
        return
    if len(files) >= MAX_RUNS:
        runs.append((hi[new], lo[new]))
        all_hi, all_lo = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
        # Runs from before a split also hold the other half's identifiers.
        own = all_hi.view(np.uint64) % prefixes == prefix
        all_hi, all_lo = all_hi[own], all_lo[own]
        by = np.lexsort((all_lo, all_hi))
        kept, saved = [], _save(folder, prefix, all_hi[by], all_lo[by])
    else:
        kept, saved = files, _save(folder, prefix, hi[new], lo[new])
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.bool_()), pa.array([prefix], pa.int32()), pa.array([saved]), pa.array(["\n".join(kept)]), pa.array([int(new.sum())])], schema=_ARROW)


class IdIndex:
    """Identifiers of all messages seen, in the shared folder."""

    def __init__(self, spark: SparkSession, path: str, prefixes: int | None = None) -> None:
        self.spark, self.path = spark, path
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.current = read_version(path) or {"version": 0, "prefixes": prefixes or least, "ids": 0, "runs": {}}

    def process(self, batch: DataFrame, ids: list[Column], order: Column) -> DataFrame:
        """(row_id, repeated) of each row of the batch; ``order`` is a unique whole number.

        The batch's identifiers are in the index when this returns.
        """
        flags = [c for i in ids for c in (i.isNull(), i)]
        rows = batch.select(F.xxhash64(*flags).alias("hi"), F.xxhash64(F.lit("second"), *flags).alias("lo"), order.cast("long").alias("row_id"))
        prefixes, version, total = self.current["prefixes"], self.current["version"] + 1, self.current["ids"]
        index = {int(k): v for k, v in self.current["runs"].items()}
        while total > PREFIX_IDS * prefixes:
            index.update({k + prefixes: v for k, v in index.items()})
            prefixes *= 2
        folder = f"{self.path}/v{version}-{uuid.uuid4().hex[:8]}"
        reduced = rows.mapInArrow(lambda it: _local(it, prefixes), "hi long, lo long, row_id long, repeated boolean, prefix int")
        placed = reduced.repartitionById(prefixes, F.col("prefix"))
        done = materialize(placed.mapInArrow(lambda it: _against_index(it, index, prefixes, folder), _OUT), "flags")
        # One row per prefix: the manifest.
        for prefix, file, keeps, ids in done.where(F.col("file").isNotNull()).select("prefix", "file", "keeps", "ids").collect():
            index[prefix] = [*filter(None, keeps.split("\n")), file]
            total += ids
        state = {"version": version, "prefixes": prefixes, "ids": total, "runs": {str(k): v for k, v in index.items()}}
        publish_version(self.spark, self.path, state)
        self.current = state
        return done.where(F.col("row_id").isNotNull()).select("row_id", "repeated")


def repeated_rows(deliveries: list[DataFrame], ids: list[Column], order: Column, path: str) -> DataFrame:
    """(row_id) of every row that is not the first of its identifier; deliveries are taken in turn."""
    index = IdIndex(deliveries[0].sparkSession, path)
    parts = [index.process(batch, ids, order) for batch in deliveries]
    return reduce(DataFrame.unionByName, parts).where(F.col("repeated")).select("row_id")
