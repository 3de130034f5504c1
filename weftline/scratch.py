"""Shared scratch tables: the one place where intermediate results are cut from their lineage.

Everything is written below ``spark.checkpoint.dir``, the folder that the driver and
all executors share, so a lost executor never takes an intermediate table with it.
"""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

_TABLES: dict[str, list[str]] = {}
#: Whether shuffle files go when their query ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set (local runs, tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str, tag: str = "") -> str:
    """A fresh folder name below the scratch root, remembered under ``tag`` for ``sweep``."""
    path = f"{scratch_root(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    _TABLES.setdefault(tag, []).append(path)
    return path


def local_folder(spark: SparkSession, name: str, tag: str = "") -> str:
    """A fresh folder of the shared scratch as a path for files that workers map, remembered as in ``new_path``."""
    path = new_path(spark, name, tag)
    where = urlsplit(path)
    if where.scheme not in ("", "file"):
        raise RuntimeError(f"files can't be mapped in {path}: set spark.checkpoint.dir to a mounted folder that driver and executors share")
    return where.path


def materialize(df: DataFrame, name: str, tag: str = "") -> DataFrame:
    """Write ``df`` as Parquet to shared scratch and return a DataFrame that reads it; the shuffle files of the write are deleted."""
    spark = df.sparkSession
    path = new_path(spark, name, tag)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system API, whatever store it lies in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def sweep(spark: SparkSession, tag: str) -> None:
    """Delete the scratch tables remembered under ``tag``; nothing may read them any more."""
    for path in _TABLES.pop(tag, []):
        delete_path(spark, path)
