"""Session factory and the shared working folder.

Operators that cut lineage or hand files from one job to the next write below
the folder named by ``spark.checkpoint.dir``, which every executor can reach.
Only where that setting is missing and the master is local do we choose a
folder ourselves.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

_own_dirs: dict[str, str] = {}


def get_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow on; keyword settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Root of the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _own_dirs[sc.applicationId]


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/tidemark-work/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage like ``checkpoint()``, survives the loss of executors, and is
    compressed and columnar, so the planner knows the size of what follows.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path below the shared folder (no error if it is gone)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all working files of this application; call when results are written."""
    drop_path(spark, f"{shared_dir(spark)}/tidemark-work/{spark.sparkContext.applicationId}")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), f"{root.name}.zip")
    Path(path).write_bytes(body.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
