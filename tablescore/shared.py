"""Where driver and executors both write."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, kind: str) -> str:
    """The name of a new folder under spark.checkpoint.dir, or under the warehouse where that is unset. A
    machine-local folder will do in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if base.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def delete_at_end(spark: SparkSession, path: str) -> str:
    """The folder goes when the application ends."""
    files, place = _place(spark, path)
    files.deleteOnExit(place)
    return path


def delete(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place
