"""The shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import atexit
from contextlib import suppress

from pyspark.sql import SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a folder in the warehouse.

    Both are places that driver and executors share, so local and cluster sessions do alike.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def _location(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path holds anything, on whatever file system it names."""
    location, files = _location(spark, path)
    return files.exists(location)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names directly below a folder; none where it is absent."""
    location, files = _location(spark, path)
    if not files.exists(location):
        return []
    return [status.getPath().getName() for status in files.listStatus(location)]


def fingerprint(spark: SparkSession, path: str) -> str:
    """A text that changes when files below the path are added, removed or rewritten."""
    location, files = _location(spark, path)
    total, status = files.getContentSummary(location), files.getFileStatus(location)
    stamps = [status.getModificationTime()]
    if status.isDirectory():
        stamps += [s.getModificationTime() for s in files.listStatus(location)]
    return f"{path}|{total.getLength()}|{total.getFileCount()}|{max(stamps)}"


def remove(spark: SparkSession, path: str) -> None:
    location, files = _location(spark, path)
    files.delete(location, True)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Remove the path when the application ends."""

    def run() -> None:
        with suppress(Exception):  # the session may be gone already
            remove(spark, path)

    atexit.register(run)
