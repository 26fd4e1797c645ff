"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder in the shared warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table written for this call.

    A lost executor costs a re-read and not the work before. The files go at the end of the
    application.
    """
    spark = df.sparkSession
    top = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}"
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made; nothing may read it any more."""
    _remove(df.sparkSession, df._written_at)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the application may be gone already
        location = spark._jvm.org.apache.hadoop.fs.Path(path)
        location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)


# Rows that travel to a Python worker at once. Texts may be long, and a batch is held whole by
# the JVM and by the worker.
BATCH_ROWS = "1000"
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession) -> None:
    """Let this session hand texts to Python workers in batches of ``BATCH_ROWS`` at most."""
    if int(spark.conf.get(BATCH_SETTING)) > int(BATCH_ROWS):
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def named(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that added columns never clash with them."""
    return F.struct(*[named(c) for c in df.columns])


def hashed_below(hashed: Column, share: float) -> Column:
    """Whether a 64-bit hash falls into the first ``share`` of all hashes.

    A sample that needs no sort and comes out alike each time. About the share of distinct
    hashes passes; to bound a sample, take the bound over the number of rows.
    """
    return F.pmod(hashed, F.lit(1 << 40)) < int(min(1.0, share) * (1 << 40))
