"""Shuffle width from the size of the input."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from math import ceil

from pyspark.sql import SparkSession

INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
DEFAULT_PARTITIONS = "spark.sql.shuffle.partitions"

# Stored bytes per shuffle partition.
PARTITION_BYTES = 128 << 20


def stored_bytes(spark: SparkSession, path: str) -> int:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(location).getLength()


def settings(
    n_bytes: int, partitions: int, partition_bytes: int | None = None
) -> dict[str, str]:
    """What to set for that much input where ``partitions`` is the present width."""
    width = ceil(n_bytes / (partition_bytes or PARTITION_BYTES))
    return {INITIAL_PARTITIONS: str(width)} if width > partitions else {}


@contextmanager
def sized_for(
    spark: SparkSession, path: str, partition_bytes: int | None = None
) -> Iterator[None]:
    """Within the block, shuffles are wide enough for the data at ``path``.

    Adaptive execution joins partitions that turn out small but never splits one, so a large
    input needs many from the start. A wider present setting stays. The session's settings
    come back at the end, so the block must run its jobs, not only plan them, and one build
    runs at a time in a session.
    """
    present = spark.conf.get(INITIAL_PARTITIONS, None) or spark.conf.get(DEFAULT_PARTITIONS)
    wanted = settings(stored_bytes(spark, path), int(present), partition_bytes)
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
