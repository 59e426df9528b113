"""A folder that the driver and all executors see, for what a query writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .sinks import remove

_local: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; only a local master may go without that setting. Gone when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="corvane-"))
            atexit.register(shutil.rmtree, _local[0], True)
        return f"{_local[0]}/{name}-{uuid.uuid4().hex}"
    path = f"{root.rstrip('/')}/corvane/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the JVM has gone; the folder is the cluster's to clear
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch folder and read again: what is built on it starts there."""
    return stored_at(df, scratch(df.sparkSession, name))


def stored_at(df: DataFrame, path: str, **options) -> DataFrame:
    """df written to path, with the writer's options, and read again."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
