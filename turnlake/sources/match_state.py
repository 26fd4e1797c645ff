"""Match numbers and bitmaps of a log, kept per load and extended by what a load adds.

The state is a log of its own snapshots: an entry's folder holds the bitmaps of a load, its keys
folder the numbers that the load gave, by hash bucket of the match, and its load id the highest of
them. A load looks its matches up in the buckets that they fall into.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.operators.match_counts import match_bitmaps, match_pairs, numbered_matches
from turnlake.schemas import TURNS
from turnlake.sources import key_index, snapshots
from turnlake.sources.folders import remove
from turnlake.sources.sizing import sized_for
from turnlake.sources.snapshots import Conflict, Entry
from turnlake.sources.turn_log import TRIES, drop_entries, read_entries

PAIRS = "match_id string, player string, opponent string"
NUMBERS = "match_id string, number long"
BITMAPS = "player string, opponent string, bucket long, matches binary"


def match_state(spark: SparkSession, path: str) -> DataFrame:
    """The bitmaps of all loads, for ``operators.match_counts.distinct_matches``."""
    folders = [f"{path}/{e.folder}" for e in snapshots.latest(spark, path).entries]
    if not folders:
        return spark.createDataFrame([], BITMAPS)
    return spark.read.schema(BITMAPS).parquet(*folders)


def update_match_state(spark: SparkSession, bronze: str, path: str) -> DataFrame:
    """Bring the state up to the bronze log, at the cost of the loads that it does not know.

    Where bronze no longer has a folder that the state was built from, as after a compaction or a
    repeated load, the state is built anew. Two updates at once end as one after the other.
    """
    for _ in range(TRIES):
        log, state = snapshots.latest(spark, bronze), snapshots.latest(spark, path)
        present = [e.folder for e in log.entries]
        whole = set(state.derived_from) <= set(present)
        entries, known = (state.entries, state.derived_from) if whole else ([], [])
        new = [e for e in log.entries if e.folder not in known]
        if not new and whole:
            break
        made = [_entry_of(spark, bronze, path, new, entries)] if new else []
        try:
            snapshots.publish(spark, path, state.next([*entries, *made], present))
            break
        except Conflict:
            drop_entries(spark, path, *made)
    else:
        raise Conflict(path)
    return match_state(spark, path)


def _entry_of(
    spark: SparkSession, bronze: str, path: str, new: list[Entry], entries: list[Entry]
) -> Entry:
    """The numbers and bitmaps of the matches in new bronze folders."""
    scratch = f"{path}/_pairs/{uuid.uuid4().hex}"
    with sized_for(spark, bronze):
        match_pairs(read_entries(spark, bronze, TURNS, new)).write.parquet(scratch)
        pairs = spark.read.schema(PAIRS).parquet(scratch)
        # Only the buckets that these matches fall into are read.
        hit = [p for paths in key_index.hit_paths(pairs, path, entries).values() for p in paths]
        known = spark.read.schema(NUMBERS).parquet(*hit) if hit else None
        unknown = pairs.join(known, "match_id", "left_anti") if hit else pairs
        after = max((int(e.load_id) for e in entries), default=0)

        n = unknown.agg(F.count_distinct("match_id")).first()[0]
        buckets = 1
        while buckets < key_index.MOST_BUCKETS and buckets * key_index.MATCHES_PER_BUCKET < n:
            buckets *= 2
        name = uuid.uuid4().hex
        entry = Entry(str(after + n), snapshots.new_folder(), f"{snapshots.KEYS}/{name}", buckets)
        fresh = numbered_matches(unknown, after)
        fresh = fresh.withColumn(key_index.BUCKET, key_index.bucket_of(buckets))
        fresh = fresh.repartition(key_index.BUCKET).sortWithinPartitions(key_index.BUCKET, "match_id")
        fresh.write.partitionBy(key_index.BUCKET).parquet(f"{path}/{entry.keys}")
        numbers = spark.read.schema(NUMBERS).parquet(f"{path}/{entry.keys}")
        numbers = numbers.select("match_id", "number")
        numbers = numbers.unionByName(known) if hit else numbers
        match_bitmaps(pairs, numbers).write.parquet(f"{path}/{entry.folder}")
    remove(spark, scratch)
    return entry
