"""Folders that the driver and all executors see, and tables kept there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that this driver made, by application.
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset a local session gets a folder of this machine; on a
    cluster it is an error, as executors would write where the driver cannot read."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lethe-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/lethe-{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Delete all tables and files that this application's operators left in the shared folder. Their results are
    lazy and read them: write what you keep first."""
    for path in _MADE.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
