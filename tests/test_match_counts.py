"""Distinct matches from bitmaps: against plain counts, per load, and the plan."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from games import log, random_rows, seat_rows
from turnlake.operators import gold
from turnlake.operators.match_counts import (
    distinct_matches,
    match_bitmaps,
    match_pairs,
    numbered_matches,
)
from turnlake.plans import pipeline
from turnlake.sources import key_index, snapshots, turn_log
from turnlake.sources.match_state import match_state, update_match_state

AGENTS = ["ann", "bob", "cyd", None]
GRAINS = [["player", "opponent"], ["player"], []]


def mixed_rows(n):
    """Matches of all pairs, self-play among them, and one that damaged rows give to two pairs."""
    rows = []
    for k in range(n):
        rows += seat_rows(f"m{k}", "CD", "DC", a=AGENTS[k % 4], b=AGENTS[k // 4 % 4])
    rows += seat_rows("m1", "C", "D", a="dee", b="ann", turns=[9])
    return rows + [{**r, "match_id": None} for r in seat_rows("x", "C", "C")]


def plain(turns, keys):
    return {tuple(r)[:-1]: r.n for r in turns.groupBy(*keys).agg(F.count_distinct("match_id").alias("n")).collect()}


def told(bitmaps, keys):
    return {tuple(r)[:-1]: r.n_matches for r in distinct_matches(bitmaps, keys).collect()}


def without_zero(counts):
    return {k: n for k, n in counts.items() if n}


@pytest.mark.parametrize("range_rows", [3, 1 << 20])
def test_numbers_are_dense_and_follow_the_pairs(spark, range_rows):
    pairs = match_pairs(log(spark, mixed_rows(50)))
    rows = numbered_matches(pairs, 7, range_rows).orderBy("number").collect()
    assert [r.number for r in rows] == list(range(8, 58))
    of = {r.match_id: tuple(sorted((r.player or "~", r.opponent or "~"))) for r in pairs.orderBy(F.desc("player")).collect()}
    runs = [of[r.match_id] for r in rows if r.match_id != "m1"]
    changes = sum(a != b for a, b in zip(runs, runs[1:], strict=False))
    assert changes == len(set(runs)) - 1


def test_bitmaps_count_as_distinct_ids_do(spark):
    turns = log(spark, mixed_rows(50))
    pairs = match_pairs(turns)
    # Numbers on both sides of a bitmap's edge.
    bitmaps = match_bitmaps(pairs, numbered_matches(pairs, 32_768 - 20))
    assert bitmaps.select("bucket").distinct().count() == 2
    for keys in GRAINS:
        assert told(bitmaps, keys) == without_zero(plain(turns, keys))
        assert told(bitmaps.unionByName(bitmaps), keys) == without_zero(plain(turns, keys))
    assert told(bitmaps.limit(0), ["player"]) == {} and told(bitmaps.limit(0), []) == {(): 0}


def test_marts_from_bitmaps_are_the_same(spark, seed):
    turns = log(spark, mixed_rows(50))
    silver = pipeline.enrich(turns)
    totals, pairs = gold.match_totals(silver), match_pairs(turns)
    bitmaps = match_bitmaps(pairs, numbered_matches(pairs))
    for build in (lambda b: gold.leaderboard(totals, seed, b), lambda b: gold.matchup_matrix(totals, b)):
        old, new = build(None), build(bitmaps)
        assert old.schema.names == new.schema.names
        assert old.exceptAll(new).isEmpty() and new.exceptAll(old).isEmpty()
    kept = spark.createDataFrame(bitmaps.collect(), bitmaps.schema)
    by_match = []
    for b in (None, kept):
        plan = gold.leaderboard(totals, seed, b)._jdf.queryExecution().executedPlan().toString()
        by_match.append(len(re.findall(r"hashpartitioning\([^)]*match_id", plan)))
    assert by_match[1] == by_match[0] - 1  # the totals' own shuffles are left


@pytest.mark.parametrize("per_bucket", [2, 10_000])
def test_state_by_load(spark, tmp_path, monkeypatch, per_bucket):
    monkeypatch.setattr(key_index, "MATCHES_PER_BUCKET", per_bucket)
    path, state, rows = str(tmp_path / "log"), str(tmp_path / "state"), mixed_rows(40)
    stamps = {}
    for k, some in enumerate((rows[:60], rows[40:90], rows[:2], rows)):
        turn_log.append_unseen(log(spark, some), path, f"load-{k}")
        bitmaps = update_match_state(spark, path, state)
        turns = turn_log.scan_turns(spark, path)
        for keys in GRAINS:
            assert told(bitmaps, keys) == without_zero(plain(turns, keys))
        files = {f: f.stat().st_mtime_ns for f in (tmp_path / "state").rglob("*.parquet")}
        assert all(files[f] == t for f, t in stamps.items())  # earlier loads stay as they are
        stamps = files
    assert snapshots.latest(spark, state).entries[-1].load_id == "40"
    again = snapshots.latest(spark, state).version
    update_match_state(spark, path, state)
    assert snapshots.latest(spark, state).version == again
    turn_log.compact(spark, path)
    assert told(update_match_state(spark, path, state), []) == {(): 40}
    assert len(snapshots.latest(spark, state).entries) == 1


def test_a_load_opens_as_much_of_a_longer_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(key_index, "MATCHES_PER_BUCKET", 4)
    opened = {}
    for n in (40, 400):
        path, state = str(tmp_path / f"log{n}"), str(tmp_path / f"state{n}")
        turn_log.append_unseen(log(spark, mixed_rows(n)), path, "first")
        update_match_state(spark, path, state)
        new = log(spark, seat_rows("m7", "CDC", "DDC") + seat_rows("new", "C", "C"))
        entries = snapshots.latest(spark, state).entries
        (paths,) = key_index.hit_paths(new, state, entries).values()
        opened[n] = spark.read.schema("match_id string, number long").parquet(*paths).count()
        turn_log.append_unseen(new, path, "second")
        assert told(update_match_state(spark, path, state), []) == {(): n + 1}
    assert opened[400] <= 2 * opened[40] + 16


def test_a_state_of_nothing(spark, tmp_path):
    assert match_state(spark, str(tmp_path / "none")).count() == 0
    turn_log.overwrite(log(spark, random_rows(1)[:0]), str(tmp_path / "log"))
    assert update_match_state(spark, str(tmp_path / "log"), str(tmp_path / "state")).count() == 0
