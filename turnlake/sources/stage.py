"""The turn log of an input folder, written once per application."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from turnlake.operators.bronze import build_bronze
from turnlake.sources.decisions import paired_decisions
from turnlake.sources.folders import (
    checkpoint_folder,
    fingerprint,
    remove_at_end,
)
from turnlake.sources.sizing import sized_for
from turnlake.sources.snapshots import has_snapshot
from turnlake.sources.turn_log import overwrite, scan_turns


def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def bronze_path(spark: SparkSession, folder: str) -> str:
    """Where this application keeps the turn log of ``folder``, building it if needed.

    Queries on the turn log start from this table, as they would from a recorded log, so
    their lineage is short and a lost executor costs a re-read and not the mapping. The path
    follows the state of the events' files, so changed events make a new log; the logs go when
    the application ends.
    """
    state = fingerprint(spark, f"{folder}/events.parquet")
    name = hashlib.md5(state.encode()).hexdigest()
    app = spark.sparkContext.applicationId
    path = f"{checkpoint_folder(spark)}/turnlake/{app}/{name}/bronze"
    if not has_snapshot(spark, path):
        with sized_for(spark, f"{folder}/events.parquet"):
            overwrite(build_bronze(paired_decisions(events(spark, folder))), path)
        remove_at_end(spark, path)
    return path


def bronze(spark: SparkSession, folder: str) -> DataFrame:
    return scan_turns(spark, bronze_path(spark, folder))
