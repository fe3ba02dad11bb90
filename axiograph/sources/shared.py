"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; /tmp/checkpoints where that is unset and driver and tasks are one process (local mode). On a
    cluster without the setting nothing is known to be shared, so this raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return "/tmp/checkpoints"
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def new_path(spark: SparkSession, what: str) -> str:
    """A place in the shared folder whose files go when the driver's Python ends."""
    if not _written:
        atexit.register(cleanup)
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cleanup() -> None:
    """Delete what lies at the places that new_path() has named."""
    while _written:
        spark, path = _written.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended
            return


def written(df: DataFrame, what: str = "step") -> str:
    """The place in the shared folder where df has been written."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return path


def settle(df: DataFrame, what: str = "step") -> DataFrame:
    """df written to the shared folder and read again: computed once, with no lineage, and safe from lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, what))
