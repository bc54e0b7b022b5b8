"""Files, tables and their layout in a lake.

``VersionedTable`` keeps immutable Parquet (or other) parts and a manifest that
is renamed into place: overwrites and compactions are atomic, a table can be
rewritten from itself, and old parts are only deleted by ``vacuum``.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from enum import Enum

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.files import open_fs, publish_version, read_version


class FileFormat(Enum):
    PARQUET = "parquet"
    DELTA = "delta"
    CSV = "csv"
    JSON = "json"
    AVRO = "avro"


class Compression(Enum):
    NONE = "none"
    SNAPPY = "snappy"
    GZIP = "gzip"
    ZSTD = "zstd"


class SaveMode(Enum):
    OVERWRITE = "overwrite"
    APPEND = "append"
    IGNORE = "ignore"
    ERROR = "error"


class Partitioning(Enum):
    NONE = "none"
    DATE = "date"
    HASH = "hash"
    COLUMN = "column"


class Location(str):
    """An address ``scheme://bucket/key`` in one spelling, which is what it is as text.

    The scheme is in lower case, the key has no leading, doubled or ``.``
    parts; one that names a folder ends in a slash.
    """

    __slots__ = ()

    def __new__(cls, text: str) -> Location:
        head, mark, rest = text.strip().partition("://")
        bucket, *parts = rest.split("/")
        kept = [p for p in parts if p.strip(". ")]
        if not (mark and head.strip() and bucket.strip() and kept):
            raise ValueError(f"not scheme://bucket/key: {text!r}")
        tail = "" if parts[-1].strip(". ") else "/"
        return super().__new__(cls, f"{head.strip().lower()}://{bucket.strip()}/{'/'.join(kept)}{tail}")

    @classmethod
    def parse(cls, uri: str) -> Location:
        return cls(uri)

    @property
    def uri(self) -> str:
        return str(self)

    @property
    def scheme(self) -> str:
        return self.partition("://")[0]

    @property
    def key(self) -> str:
        return self.partition("://")[2].partition("/")[2]

    @property
    def name(self) -> str:
        return self.rstrip("/").rpartition("/")[2]

    @property
    def parent(self) -> str:
        """The key of the folder that holds it; empty at the top of the bucket."""
        above, slash, _ = self.key.rstrip("/").rpartition("/")
        return above + slash


@dataclass(frozen=True)
class Dataset:
    """A table of a zone and how it is stored; ``keep_days`` 0 is for ever."""

    zone: str
    domain: str
    name: str
    file_format: FileFormat = FileFormat.PARQUET
    compression: Compression = Compression.SNAPPY
    partitioning: Partitioning = Partitioning.NONE
    partition_columns: tuple[str, ...] = ()
    hash_partitions: int = 16
    keep_days: int = 0

    def __post_init__(self) -> None:
        if self.keep_days < 0:
            raise ValueError("a table cannot be kept for less than no days")

    def path(self, partitions: Mapping[str, str | int] | None = None, filename: str = "") -> str:
        """``zone/domain/name/k=v/.../filename``."""
        keys = "".join(f"{k}={v}/" for k, v in (partitions or {}).items())
        return f"{self.zone}/{self.domain}/{self.name}/{keys}{filename}"

    def write(self, df: DataFrame, root: str, mode: SaveMode = SaveMode.OVERWRITE) -> str:
        """Write below ``root`` in the dataset's format, codec and partitions; returns the path."""
        target = f"{root.rstrip('/')}/{self.path()}"
        columns = list(self.partition_columns)
        if self.partitioning is Partitioning.HASH:
            df = df.withColumn("part", F.pmod(F.xxhash64(*columns), F.lit(self.hash_partitions)))
            columns = ["part"]
        elif self.partitioning is Partitioning.DATE:
            df = df.withColumn("part_date", F.to_date(columns[0]))
            columns = ["part_date"]
        # Rows of a partition meet before the write, so it has few files; a large one is split over tasks.
        writer = (df.hint("rebalance", *columns) if columns else df).write.format(self.file_format.value).mode(mode.value)
        if self.file_format is not FileFormat.DELTA:
            codec = self.compression.value
            if self.file_format in (FileFormat.CSV, FileFormat.JSON) and self.compression is Compression.SNAPPY:
                codec = "none"
            writer = writer.option("compression", codec)
        (writer.partitionBy(*columns) if columns else writer).save(target)
        return target


# --- Objects --------------------------------------------------------------------------


class ObjectStore:
    """exists, upload, download, delete, copy, move, list and head below a root."""

    def __init__(self, root: str) -> None:
        self.fs, self.root = open_fs(root)

    def _at(self, key: str) -> str:
        return posixpath.join(self.root, key.lstrip("/"))

    def exists(self, key: str) -> bool:
        return self.fs.get_file_info(self._at(key)).type != pafs.FileType.NotFound

    def upload(self, key: str, body: bytes) -> None:
        self.fs.create_dir(posixpath.dirname(self._at(key)), recursive=True)
        with self.fs.open_output_stream(self._at(key)) as f:
            f.write(body)

    def download(self, key: str) -> bytes:
        with self.fs.open_input_stream(self._at(key)) as f:
            return f.read()

    def delete(self, key: str) -> None:
        if self.exists(key):
            self.fs.delete_file(self._at(key))

    def delete_prefix(self, prefix: str) -> int:
        """Delete what lies below a prefix; returns how many objects went."""
        keys = self.list(prefix)
        for k in keys:
            self.delete(k)
        return len(keys)

    def copy(self, source: str, target: str) -> None:
        self.fs.create_dir(posixpath.dirname(self._at(target)), recursive=True)
        self.fs.copy_file(self._at(source), self._at(target))

    def move(self, source: str, target: str) -> None:
        self.copy(source, target)
        self.delete(source)

    def list(self, prefix: str = "") -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(self._at(prefix), recursive=True, allow_not_found=True))
        return sorted(posixpath.relpath(i.path, self.root) for i in found if i.is_file)

    def head(self, key: str) -> dict:
        info = self.fs.get_file_info(self._at(key))
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(key)
        return {"size": info.size, "modified": info.mtime}


def merged_schema(one: StructType, other: StructType) -> StructType:
    """The fields of both, in order of appearance; a field of two types is an error."""
    known = {f.name.lower(): f for f in one.fields}
    for f in other.fields:
        if (was := known.get(f.name.lower())) and was.dataType != f.dataType:
            raise ValueError(f"column {f.name!r} is {was.dataType.simpleString()} in the table and {f.dataType.simpleString()} in the part")
    return StructType([*one.fields, *(f for f in other.fields if f.name.lower() not in known)])


# --- Versioned tables ----------------------------------------------------------------------


@dataclass(frozen=True)
class Detail:
    version: int
    files: int
    size: int


class VersionedTable:
    """A table of immutable parts named by a manifest.

    Appended parts may add columns; a column that a part lacks is null there,
    one of another type is refused. A batch is written under a key once: again
    under the same key it replaces itself, and if a compaction has taken its part
    up it is known and left as it is. Of two writers at once one gets a ConflictError.
    """

    def __init__(self, spark: SparkSession, path: str, file_format: str = "parquet") -> None:
        self.spark, self.path, self.format = spark, path.rstrip("/"), file_format

    @property
    def state(self) -> dict:
        return read_version(self.path) or {"version": 0, "parts": [], "schema": None, "covered": []}

    def exists(self) -> bool:
        return self.state["version"] > 0

    def write(self, df: DataFrame, mode: SaveMode | str = SaveMode.OVERWRITE, key: str | None = None) -> int:
        """Write a new part and publish it; ``key`` names the batch it holds."""
        mode, state = SaveMode(mode), self.state
        if state["version"] and mode is SaveMode.IGNORE:
            return state["version"]
        if state["version"] and mode is SaveMode.ERROR:
            raise FileExistsError(self.path)
        append = mode is SaveMode.APPEND
        if append and key is not None and key in state["covered"]:
            return state["version"]
        schema = merged_schema(StructType.fromJson(json.loads(state["schema"])), df.schema) if append and state["schema"] else df.schema
        # A file is never written twice: readers of the version before still have theirs.
        part = f"part-{key or ''}-{uuid.uuid4().hex}"
        df.write.format(self.format).mode("overwrite").save(f"{self.path}/{part}")
        kept = [p for p in state["parts"] if key is None or not p.startswith(f"part-{key}-")] if append else []
        return self._publish(state, [*kept, part], schema, state["covered"] if append else [])

    def _publish(self, state: dict, parts: list[str], schema: StructType, covered: list[str]) -> int:
        version = state["version"] + 1
        publish_version(self.spark, self.path, {"version": version, "parts": parts, "schema": schema.json(), "covered": covered})
        return version

    def schema(self) -> StructType | None:
        """The published schema; None if nothing was written; an error if the manifest lacks it."""
        state = self.state
        if not state["version"]:
            return None
        if not state.get("schema"):
            raise RuntimeError(f"{self.path} was written without a schema")
        return StructType.fromJson(json.loads(state["schema"]))

    def read(self) -> DataFrame:
        state = self.state
        if not state["version"]:
            raise FileNotFoundError(self.path)
        paths = [f"{self.path}/{p}" for p in state["parts"]]
        return self.spark.read.schema(self.schema()).format(self.format).load(paths)

    def _files(self, parts: Sequence[str]) -> list[pafs.FileInfo]:
        fs, root = open_fs(self.path)
        found = []
        for p in parts:
            found += [i for i in fs.get_file_info(pafs.FileSelector(f"{root}/{p}", recursive=True, allow_not_found=True)) if i.is_file and not i.base_name.startswith(("_", "."))]
        return found

    def detail(self) -> Detail:
        state = self.state
        files = self._files(state["parts"])
        return Detail(state["version"], len(files), sum(f.size for f in files))

    def compact(self, target_bytes: int = 128 * 2**20) -> tuple[int, int]:
        """Rewrite small files into files of about ``target_bytes``; (files before, files after). Idempotent."""
        before = self.detail()
        wanted = max(1, -(-before.size // target_bytes))
        if before.files <= wanted:
            return before.files, before.files
        state, part = self.state, f"part--{uuid.uuid4().hex}"
        self.read().coalesce(wanted).write.format(self.format).save(f"{self.path}/{part}")
        keys = [k for p in state["parts"] if (k := p.removeprefix("part-").rpartition("-")[0])]
        self._publish(state, [part], self.schema(), sorted({*state["covered"], *keys}))
        return before.files, self.detail().files

    def vacuum(self, retention_hours: float = 168) -> int:
        """Delete parts that no manifest names and that are older; returns how many files went."""
        fs, root = open_fs(self.path)
        live, limit, gone = set(self.state["parts"]), time.time() - retention_hours * 3600, 0
        for part in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if part.type == pafs.FileType.Directory and part.base_name.startswith("part-") and part.base_name not in live:
                files = [i for i in fs.get_file_info(pafs.FileSelector(part.path, recursive=True)) if i.is_file]
                if files and max(i.mtime.timestamp() for i in files) < limit:
                    fs.delete_dir(part.path)
                    gone += len(files)
        return gone


# --- Raw landing -----------------------------------------------------------------------------


def read_raw(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """All Parquet files below a prefix."""
    reader = spark.read.option("recursiveFileLookup", "true")
    return (reader.schema(schema) if schema is not None else reader).parquet(path)


def land_raw(df: DataFrame, root: str, entity: str, clear: bool = False) -> str:
    """Append one extraction under ``root/raw/<entity>/``; ``clear`` first empties the prefix (a re-run)."""
    if clear:
        ObjectStore(root).delete_prefix(f"raw/{entity}")
    path = f"{root.rstrip('/')}/raw/{entity}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def ingest_bronze(spark: SparkSession, root: str, entities: Sequence[str], schemas: Mapping[str, StructType] | None = None) -> dict[str, int]:
    """raw -> Bronze overwrite for many entities; failures of single ones are raised together at the end."""
    counts, errors = {}, []
    for e in [x.strip() for x in entities if x.strip()]:
        try:
            target = VersionedTable(spark, f"{root.rstrip('/')}/bronze_batch/{e}")
            target.write(read_raw(spark, f"{root.rstrip('/')}/raw/{e}", (schemas or {}).get(e)))
            counts[e] = target.read().count()
        except Exception as x:  # noqa: BLE001
            errors.append(f"{e}: {type(x).__name__}: {str(x).splitlines()[0]}")
    if errors:
        raise RuntimeError("; ".join(errors))
    return counts
