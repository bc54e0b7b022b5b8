"""Small helpers for files in the shared folder, from the driver and from tasks."""

from __future__ import annotations

import json
import re
import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, in the driver or in a task."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def read_json(uri: str) -> dict | None:
    fs, path = open_fs(uri)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


class ConflictError(RuntimeError):
    """Another writer published the version first."""


def read_version(folder: str, name: str = "CURRENT") -> dict | None:
    """The newest value that ``publish_version`` put there."""
    fs, path = open_fs(folder)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    versions = [int(n) for i in found if (n := i.base_name.removeprefix(f"{name}.")) != i.base_name and n.isdigit()]
    return read_json(f"{folder}/{name}.{max(versions):012d}") if versions else None


def publish_version(spark: SparkSession, folder: str, value: dict, name: str = "CURRENT", kept: int = 8) -> None:
    """Publish ``value`` as number ``value["version"]``; a ConflictError if that number is taken.

    A value is made from the version before it, so of two writers at once one
    is refused and nothing is lost. The last ``kept`` values stay for readers.
    """
    version = value["version"]
    uri = f"{folder}/{name}.{version:012d}"
    temp = f"{folder}/_{name}.{uuid.uuid4().hex}"
    fs, path = open_fs(temp)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(json.dumps(value).encode())
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    src, dst = jvm.org.apache.hadoop.fs.Path(temp), jvm.org.apache.hadoop.fs.Path(uri)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(dst.toUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(src, dst, options)
    except Exception as e:  # noqa: BLE001
        fs.delete_file(path)
        if fs.get_file_info(open_fs(uri)[1]).type != pafs.FileType.NotFound:
            raise ConflictError(f"version {version} of {folder} was published by another writer") from e
        raise
    old = open_fs(f"{folder}/{name}.{version - kept:012d}")[1] if version > kept else None
    if old and fs.get_file_info(old).type != pafs.FileType.NotFound:
        fs.delete_file(old)


def publish_json(spark: SparkSession, uri: str, value: dict) -> None:
    """Write ``value`` beside ``uri`` and rename it over: readers see the old or the new, never a part."""
    temp = f"{uri}.{uuid.uuid4().hex}"
    fs, path = open_fs(temp)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(json.dumps(value).encode())
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    src, dst = jvm.org.apache.hadoop.fs.Path(temp), jvm.org.apache.hadoop.fs.Path(uri)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(dst.toUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(src, dst, options)
