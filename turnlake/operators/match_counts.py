"""Exact numbers of distinct matches that can be merged: bitmaps over dense match numbers.

A match has one number for good. Numbers follow the order of the pairs that play, so the matches
of a pair lie close together and its bitmaps, of 4 KB for 32,768 numbers, are few and well filled.
Bitmaps per pair give those per agent and of the whole log, and those of new loads are put to the
old ones by OR, so a match that arrives in parts counts once and no ids are compared again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.operators.skew import RANGE_ROWS, numbered_by_range

PAIR = ["player", "opponent"]


def match_pairs(turns: DataFrame) -> DataFrame:
    """(match_id, player, opponent), each once; turns without a match id are in no match."""
    return turns.where("match_id IS NOT NULL").select("match_id", *PAIR).distinct()


def numbered_matches(
    pairs: DataFrame, after: int = 0, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """(match_id, number): the matches of ``pairs`` numbered from ``after + 1`` without gaps.

    A match between several pairs, as damaged logs have them, is numbered with the first of them.
    """
    seats = F.array_sort(F.array(*PAIR))
    first = F.min(F.struct(seats.getItem(0).alias("a"), seats.getItem(1).alias("b")))
    matches = pairs.groupBy("match_id").agg(first.alias("_pair"))
    order = [F.col("_pair"), F.col("match_id")]
    placed = numbered_by_range(matches, [], order, "_place", range_rows)
    return placed.select("match_id", (F.col("_place") + after).cast("long").alias("number"))


def match_bitmaps(pairs: DataFrame, numbers: DataFrame) -> DataFrame:
    """(player, opponent, bucket, matches): the numbers of each pair's matches as bitmaps.

    A group is one bucket of one pair, so it has 32,768 matches at most. Rows travel once, as
    numbers: partial bitmaps of scattered rows would be larger than the rows.
    """
    number = pairs.join(numbers, "match_id").select(
        *PAIR,
        F.bitmap_bucket_number("number").alias("bucket"),
        F.bitmap_bit_position("number").alias("_bit"),
    )
    grouped = number.repartition(*PAIR, "bucket").groupBy(*PAIR, "bucket")
    return grouped.agg(F.bitmap_construct_agg("_bit").alias("matches"))


def distinct_matches(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, n_matches): exact counts for pairs, for agents or, without keys, for the log.

    ``bitmaps`` may be the union of those of several loads.
    """
    merged = bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("matches").alias("matches"))
    n = F.coalesce(F.sum(F.bitmap_count("matches")), F.lit(0)).cast("long")
    return merged.groupBy(*keys).agg(n.alias("n_matches"))
