"""Snapshots, key index, compaction, silver by load and the switch of tables."""

from __future__ import annotations

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from games import log, random_rows, seat_rows
from turnlake.operators.silver import enrich
from turnlake.plans import pipeline
from turnlake.sources import key_index, snapshots, turn_log
from turnlake.sources.layers import as_table


def same(a, b) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def files(path) -> dict[str, int]:
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_runs_of_turns(spark):
    rows = seat_rows("m", "CDCDCD", "DDCCDD", turns=[1, 2, 3, 7, 300, 301])
    rows += rows[:4] + [{**rows[0], "turn": None}, {**rows[0], "match_id": None}]
    runs = key_index.key_runs(log(spark, rows)).where("seat = 'A'").collect()
    got = {(r.match_id, r._block, r.low, r.high) for r in runs}
    assert got == {
        ("m", 0, 1, 3),
        ("m", 0, 7, 7),
        ("m", 1, 300, 301),
        ("m", None, None, None),
        (None, 0, 1, 1),
    }


def test_runs_of_turns_are_found_by_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """Spark would join tasks by their stored bytes, which tell little of keys."""
    turns, path = log(spark, random_rows(5, n_matches=30, gaps=True)), str(tmp_path / "log")
    one, many = key_index.key_runs(turns), key_index.key_runs(turns, 7)
    assert (one.rdd.getNumPartitions(), many.rdd.getNumPartitions()) == (1, 7)
    assert same(one, many)
    monkeypatch.setattr(key_index, "TASK_TURNS", turns.count() // 5)
    turn_log.append_unseen(turns, path, "first")
    found = key_index.recorded_runs(turns, path, snapshots.latest(spark, path).entries)
    assert same(found.drop("folder").select(*one.columns), one)


def test_appends_neither_broadcast_the_index_nor_sort_what_they_read(spark, tmp_path):
    path, rows = str(tmp_path / "log"), random_rows(6, n_matches=10)
    rows += [{**r, "match_id": None} for r in seat_rows("x", "CD", "DD")]
    turn_log.append_unseen(log(spark, rows[::2]), path, "first")
    # Read back: a plan over local rows may come out differently.
    log(spark, rows + rows[:7]).write.parquet(str(tmp_path / "rows"))
    loaded = turn_log.without_copies(spark.read.parquet(str(tmp_path / "rows")))
    runs = key_index.recorded_runs(loaded, path, snapshots.latest(spark, path).entries)
    new = key_index.without_recorded(loaded, runs)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    plan = loaded._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.rindex("Aggregate") < plan.index("Exchange")
    for got, want in ((new, rows[1::2]), (loaded, rows)):
        assert sorted(map(repr, got.collect())) == sorted(map(repr, log(spark, want).collect()))


@pytest.mark.parametrize("per_bucket", [1, 3, 10_000])
def test_appends_find_recorded_turns(spark, tmp_path, monkeypatch, per_bucket):
    monkeypatch.setattr(key_index, "MATCHES_PER_BUCKET", per_bucket)
    path, rows = str(tmp_path / "log"), random_rows(11, n_matches=20, gaps=True)
    rows += [{**r, "turn": None} for r in seat_rows("no-turn", "C", "D")]
    rows += [{**r, "match_id": None} for r in seat_rows("x", "CD", "DD")]
    for k, some in enumerate((rows[::3], rows[::2], rows, rows[:9])):
        turn_log.append_unseen(log(spark, some), path, f"load-{k}")
    assert same(turn_log.scan_turns(spark, path), log(spark, rows))


def test_a_load_opens_as_much_of_a_longer_log(spark, tmp_path, monkeypatch):
    """Ten times the log, and the same load opens no more of its index."""
    monkeypatch.setattr(key_index, "MATCHES_PER_BUCKET", 4)
    opened = {}
    for n in (40, 400):
        path = str(tmp_path / f"log{n}")
        rows = [r for k in range(n) for r in seat_rows(f"m{k}", "CD", "DD")]
        turn_log.append_unseen(log(spark, rows), path, "first")
        entries = snapshots.latest(spark, path).entries
        new = log(spark, seat_rows("m7", "CDC", "DDC") + seat_rows("new", "C", "C"))
        paths = key_index.hit_paths(new, path, entries)[entries[0].folder]
        runs = key_index.recorded_runs(new, path, entries)
        opened[n] = len(paths), runs.count()
        assert len(runs.inputFiles()) <= len(paths) * 4
        turn_log.append_unseen(new, path, "second")
        assert turn_log.scan_turns(spark, path).count() == 4 * n + 4
    assert opened[400][0] <= opened[40][0] <= 2 and opened[400][1] <= 2 * opened[40][1] + 16


def dying(df):
    return df.withColumn("payoff", F.expr("if(turn > 1, CAST(raise_error('dies') AS INT), payoff)"))


def test_a_rebuild_that_dies_leaves_the_log(spark, tmp_path):
    path, rows = str(tmp_path / "log"), log(spark, random_rows(1))
    turn_log.overwrite(rows, path)
    for change in (turn_log.overwrite, lambda df, p: turn_log.append_unseen(df, p, "x")):
        with pytest.raises(Exception, match="dies"):
            change(dying(log(spark, random_rows(5, n_matches=30))), path)
        assert same(turn_log.scan_turns(spark, path), rows)


def test_a_reader_keeps_the_state_it_began_with(spark, tmp_path):
    path, first = str(tmp_path / "log"), log(spark, random_rows(1))
    turn_log.overwrite(first, path)
    reader = turn_log.scan_turns(spark, path)
    turn_log.overwrite(log(spark, random_rows(2)), path)
    assert same(reader, first)
    for seed in (3, 4, 5):
        turn_log.overwrite(log(spark, random_rows(seed)), path)
    # Two states are kept: the present one and the one before.
    assert len([f for f in Path(path).iterdir() if f.name.startswith("build=")]) == 2


def test_the_same_number_cannot_be_published_twice(spark, tmp_path):
    path = str(tmp_path / "log")
    turn_log.overwrite(log(spark, random_rows(1)), path)
    state = snapshots.latest(spark, path)
    snapshots.publish(spark, path, state.next(state.entries))
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, path, state.next([]))
    assert snapshots.latest(spark, path).entries == state.entries


def test_loads_at_once_lose_and_double_nothing(spark, tmp_path):
    path, rows = str(tmp_path / "log"), random_rows(21, n_matches=10)
    parts = [rows[::2] + rows[::3], rows[1::2] + rows[::5], rows[:40]]
    failed = []

    def load(k: int) -> None:
        try:
            turn_log.append_unseen(log(spark, parts[k]), path, f"load-{k}")
        except Exception as error:  # told to the test's own thread
            failed.append(error)

    threads = [threading.Thread(target=load, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert same(turn_log.scan_turns(spark, path), log(spark, rows))
    assert len(snapshots.latest(spark, path).entries) == 3


def test_logs_without_snapshots_go_on(spark, tmp_path):
    path, rows = str(tmp_path / "log"), random_rows(6)
    log(spark, rows[:20]).write.parquet(f"{path}/load_id=a")
    log(spark, rows[20:30]).write.parquet(f"{path}/load_id=b")
    assert same(turn_log.scan_turns(spark, path), log(spark, rows[:30]))
    turn_log.append_unseen(log(spark, rows), path, "c")
    assert same(turn_log.scan_turns(spark, path), log(spark, rows))


def rows_read(df) -> int:
    """What the scan hands on, after row groups and pages that cannot match are skipped."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def many_turns(spark, n_matches: int, n_turns: int):
    turns = spark.range(n_matches * n_turns).selectExpr(
        f"md5(CAST(id div {n_turns} AS STRING)) AS match_id",
        f"CAST(1 + id % {n_turns} AS INT) AS turn",
        "'A' AS seat",
        "'C' AS move",
    )
    return turn_log.conform(turns)


@pytest.mark.parametrize("compacted", [False, True])
def test_a_match_is_looked_up_in_few_rows(spark, tmp_path, compacted):
    path, turns = str(tmp_path / "log"), many_turns(spark, 4000, 50)
    for k in range(2):
        part = turns.where(f"crc32(match_id) % 2 = {k}")
        turn_log.append_unseen(part.repartition(8), path, f"load-{k}")
    if compacted:
        turn_log.compact(spark, path)
    match = turns.first().match_id
    found = turn_log.scan_match(spark, path, match)
    assert same(found, turns.where(F.col("match_id") == match))
    assert len({f.rsplit("/", 2)[1] for f in found.inputFiles()}) == 1  # one folder
    assert rows_read(found) <= (20_000 if compacted else 100_000)
    assert turn_log.scan_match(spark, path, "8" * 32).isEmpty()


def test_files_tell_that_they_lack_a_match(spark, tmp_path):
    """No index, and ids that lie between those of every file."""
    path, turns = str(tmp_path / "log"), many_turns(spark, 60_000, 2)
    turn_log.overwrite(turns.repartition(4, "match_id"), path)
    assert rows_read(turn_log.scan_match(spark, path, "8" * 32)) == 0
    match = turns.first().match_id
    found = turn_log.scan_match(spark, path, match)
    assert found.count() == 2 and rows_read(found) <= 30_000


def test_look_up_of_turns_without_an_id(spark, tmp_path):
    path, rows = str(tmp_path / "log"), seat_rows("m", "CD", "DD")
    rows += [{**r, "match_id": None} for r in rows]
    turn_log.append_unseen(log(spark, rows), path, "a")
    for match, other in (("m", None), (None, "m")):
        found = turn_log.scan_match(spark, path, match)
        assert found.count() == 4 and found.schema == turn_log.TURNS
        assert found.where(F.col("match_id").eqNullSafe(other)).isEmpty()
    with pytest.raises(Exception):  # no log at all, as for any scan
        turn_log.scan_match(spark, str(tmp_path / "none"), "m").collect()


def test_compaction_keeps_rows_and_what_is_known(spark, tmp_path):
    path, rows = str(tmp_path / "log"), random_rows(14, gaps=True)
    for k in range(4):
        turn_log.append_unseen(log(spark, rows[k::4]), path, f"load-{k}")
    turn_log.compact(spark, path)
    assert len(snapshots.latest(spark, path).entries) == 1
    assert same(turn_log.scan_turns(spark, path), log(spark, rows))
    for k in range(2):
        turn_log.append_unseen(log(spark, rows[k::4]), path, f"load-{k}")
    assert same(turn_log.scan_turns(spark, path), log(spark, rows))


@pytest.mark.parametrize("block_turns", [100_000, 4])
def test_silver_by_load_is_the_full_rebuild(spark, tmp_path, block_turns):
    bronze, silver = str(tmp_path / "bronze"), str(tmp_path / "silver")
    rows = random_rows(31, n_matches=12)
    rows += [{**r, "match_id": None} for r in seat_rows("x", "CD", "DD")]
    late = [r for r in rows if r["match_id"] in ("m2", "m3") and r["turn"] % 2]
    early = [r for r in rows if r not in late]
    second = [r for r in early if (r["match_id"] or "") > "m5"]
    first = [r for r in early if r not in second]

    def update(part, load):
        turn_log.append_unseen(log(spark, part), bronze, load)
        got = pipeline.update_silver(spark, bronze, silver, block_turns)
        assert same(got, enrich(turn_log.scan_turns(spark, bronze), block_turns))

    update(first, "a")
    before = files(silver)
    update(second, "b")  # new matches: the folder of the first load stays as it is
    assert before.items() <= files(silver).items()
    two = snapshots.latest(spark, silver).entries
    update(late, "c")  # the second load's folder holds none of the late matches
    entries = snapshots.latest(spark, silver).entries
    assert two[1].folder in {e.folder for e in entries} and two[0].folder not in {e.folder for e in entries}
    stamps = files(silver)
    pipeline.update_silver(spark, bronze, silver, block_turns)
    assert files(silver) == stamps  # nothing new, nothing written
    turn_log.compact(spark, bronze)  # other folders: built whole again
    got = pipeline.update_silver(spark, bronze, silver, block_turns)
    assert same(got, enrich(turn_log.scan_turns(spark, bronze), block_turns))


def test_tables_switch_in_one_call(spark, tmp_path):
    root = str(tmp_path)
    for n in (5, 3):
        assert as_table(spark.range(n), "switch_test", "t", root).count() == n
    odd = spark.range(4).selectExpr("id AS `a ``b`", "named_struct('x y', id) AS `s.t`")
    assert as_table(odd, "switch_test", "t", root).columns == ["a `b", "s.t"]
    assert spark.table("switch_test.t").count() == 4
    # Columns that no table can have: the old table stays.
    twice = spark.range(2).selectExpr("id AS x", "id AS y").toDF("x", "X")
    with pytest.raises(Exception):
        as_table(twice, "switch_test", "t", root)
    assert spark.table("switch_test.t").count() == 4
    spark.sql("DROP SCHEMA switch_test CASCADE")
