"""The key index of a log: which turns each of its folders holds, by hash bucket of the match.

An index row is a run of consecutive turns of a match and seat, so a recorded match is a row or
two. Buckets are folders, about as many as the matches need, so a load opens those that its own
matches fall into, whatever the length of the log.
"""

from __future__ import annotations

import uuid
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.schemas import TURN_KEY
from turnlake.sources.folders import names_in
from turnlake.sources.snapshots import KEYS, Entry

# Runs do not cross blocks of so many turns, which bounds the runs that a turn is compared with.
RUN_TURNS = 256
MATCHES_PER_BUCKET = 10_000
MOST_BUCKETS = 1 << 16
# Turns, about, whose runs one task finds. Keys shrink so much when stored that Spark, which goes by
# stored bytes, would give a task many more.
TASK_TURNS = 1 << 18
BUCKET = "bucket"
RUNS = "match_id string, seat string, _block long, low int, high int"


def run_block() -> Column:
    return F.expr(f"CAST(turn AS BIGINT) div {RUN_TURNS}")


def key_runs(turns: DataFrame, tasks: int = 1) -> DataFrame:
    """(match_id, seat, _block, low, high): runs of consecutive turns; a null turn is a run."""
    at = ["match_id", "seat", "_block"]
    order = Window.partitionBy(*at).orderBy("turn")
    run = F.col("turn") - F.dense_rank().over(order)
    return (
        turns.select(*TURN_KEY, run_block().alias("_block"))
        .repartition(tasks, *at)
        .withColumn("_run", run)
        .groupBy(*at, "_run")
        .agg(F.min("turn").cast("int").alias("low"), F.max("turn").cast("int").alias("high"))
        .drop("_run")
    )


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("match_id"), F.lit(buckets))


def write_index(spark: SparkSession, path: str, entry: Entry) -> Entry:
    """The entry with an index of its folder."""
    turns = spark.read.schema("match_id string, seat string, turn int").parquet(
        f"{path}/{entry.folder}".rstrip("/")
    )
    n_matches, n_turns = turns.agg(
        F.approx_count_distinct("match_id"), F.count(F.lit(1))
    ).first()
    buckets = 1
    while buckets < MOST_BUCKETS and buckets * MATCHES_PER_BUCKET < n_matches:
        buckets *= 2
    keys = f"{KEYS}/{uuid.uuid4().hex}"
    runs = key_runs(turns, max(1, ceil(n_turns / TASK_TURNS)))
    runs = runs.withColumn(BUCKET, bucket_of(buckets))
    runs = runs.repartition(buckets, BUCKET).sortWithinPartitions(BUCKET, "match_id")
    runs.write.partitionBy(BUCKET).parquet(f"{path}/{keys}")
    return Entry(entry.load_id, entry.folder, keys, buckets)


def hit_paths(rows: DataFrame, path: str, entries: list[Entry]) -> dict[str, list[str]]:
    """By folder: the index buckets that matches of ``rows`` fall into.

    Bucket counts are powers of two, so the buckets under the greatest tell all others. Their
    number is bounded by ``MOST_BUCKETS``.
    """
    most = max((e.buckets for e in entries), default=0)
    if not most:
        return {}
    hits = {r[0] for r in rows.select(bucket_of(most)).distinct().collect()}
    out = {}
    for entry in entries:
        there = set(names_in(rows.sparkSession, f"{path}/{entry.keys}"))
        names = {f"{BUCKET}={h % entry.buckets}" for h in hits} & there
        out[entry.folder] = [f"{path}/{entry.keys}/{n}" for n in sorted(names)]
    return out


def recorded_runs(rows: DataFrame, path: str, entries: list[Entry]) -> DataFrame:
    """The runs of the log that may hold turns of ``rows``, with the ``folder`` of each."""
    spark = rows.sparkSession
    parts = [
        spark.read.schema(RUNS).parquet(*paths).withColumn("folder", F.lit(folder))
        for folder, paths in hit_paths(rows, path, entries).items()
        if paths
    ]
    if not parts:
        return spark.createDataFrame([], RUNS + ", folder string")
    return reduce(DataFrame.unionByName, parts)


def without_recorded(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows whose turn is in none of the runs; missing parts of a key compare as equal.

    Both sides are shuffled: files of runs are small for what they hold, so those that Spark would
    broadcast take hundreds of megabytes in every task.
    """
    left = rows.withColumn("_block", run_block()).alias("rows")
    same = " AND ".join(f"rows.{c} <=> runs.{c}" for c in ("match_id", "seat", "_block"))
    inside = "(rows.turn BETWEEN runs.low AND runs.high OR rows.turn IS NULL AND runs.low IS NULL)"
    kept = left.join(runs.hint("merge").alias("runs"), F.expr(f"{same} AND {inside}"), "left_anti")
    return kept.select(*rows.columns)
