from __future__ import annotations

import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import FOLDER
from games import log, random_rows, seat_rows
from turnlake.operators import schedule
from turnlake.operators.bronze import build_bronze
from turnlake.operators import gold
from turnlake.operators.quality import accepted_values_tests
from turnlake.operators.silver import enrich
from turnlake.operators.skew import numbered, numbered_by_range, with_range
from turnlake.schemas import AGENT_META, AGENTS, SEED, TURNS
from turnlake.sources import sizing, stage, turn_log
from turnlake.sources.decisions import paired_decisions
from turnlake.sources.layers import as_table, as_view, drop_tables
from turnlake.sources.seed import seed_agents
from turnlake.streaming.ingest import load_arrivals


def same(a, b) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_split_users_give_the_same_log(spark):
    events = stage.events(spark, FOLDER)
    whole = build_bronze(paired_decisions(events))
    assert same(whole, build_bronze(paired_decisions(events, range_rows=1)))
    assert same(whole, build_bronze(paired_decisions(events, range_rows=50)))


def test_zoned_times_read_in_utc(spark):
    events = stage.events(spark, FOLDER)
    whole = build_bronze(paired_decisions(events))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        zoned = events.withColumn("ts", F.expr("to_utc_timestamp(CAST(ts AS TIMESTAMP), 'UTC')"))
        micros = "unix_micros(CAST(concat(CAST(ts AS STRING), 'Z') AS TIMESTAMP))"
        zoned = events.withColumn("ts", F.expr(f"timestamp_micros({micros})"))
        assert same(whole, build_bronze(paired_decisions(zoned)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("user", ["id", "xxhash64(id) & 4611686018427387903"])
def test_blocks_of_users_with_dense_and_hashed_ids(spark, user):
    from turnlake.sources.decisions import matches

    users = spark.range(4000).selectExpr(f"{user} AS user_id")
    events = users.distinct().withColumn("e", F.explode(F.sequence(F.lit(1), F.lit(2))))
    got = matches(events, users_per_block=500)
    want = got.selectExpr("user_id", "row_number() OVER (PARTITION BY ia, ib ORDER BY user_id) AS repeat")
    assert same(got.select("user_id", F.col("repeat").cast("int")), want)


def test_one_user_with_most_events(spark):
    events = stage.events(spark, FOLDER)
    hot = events.withColumn(
        "user_id", F.when(F.col("event_id") % 3 == 0, 9).otherwise(F.col("user_id"))
    )
    assert same(
        build_bronze(paired_decisions(hot)),
        build_bronze(paired_decisions(hot, range_rows=20)),
    )


def test_bronze_counts(bronze):
    assert bronze.count() == 992
    assert bronze.select("match_id").distinct().count() == 15
    assert bronze.schema == TURNS


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_numbered_equals_row_number(spark, width):
    df = spark.range(400).selectExpr("id", "id * 7919 % 401 AS v", "if(id % 3 = 0, 0, id % 5) AS k")
    got = numbered(df, ["k"], [F.col("v")], F.expr(f"v div {width}"), "n")
    expected = df.selectExpr(
        "id", "v", "k", "CAST(row_number() OVER (PARTITION BY k ORDER BY v) AS BIGINT) AS n"
    )
    assert same(got.select("id", "v", "k", "n"), expected)


def most_in_a_range(df, order, range_rows: int) -> int:
    sizes = with_range(df, order, "r", range_rows).groupBy("r").count()
    return sizes.agg(F.max("count")).first()[0]


@pytest.mark.parametrize("range_rows", [1, 50, 10**6])
def test_numbered_by_range_equals_row_number(spark, range_rows):
    """Ties, nulls, negative zeros, and a key with a third of all rows."""
    df = spark.range(400).selectExpr(
        "id",
        "if(id % 7 = 0, NULL, if(id % 2 = 0, 1.5, if(id % 3 = 0, -0.0, id * 7919 % 401))) AS v",
        "if(id % 3 = 0, 0, id % 5) AS k",
    )
    got = numbered_by_range(df, ["k"], [F.col("v"), F.col("id")], "n", range_rows)
    number = "CAST(row_number() OVER (PARTITION BY k ORDER BY v, id) AS BIGINT) AS n"
    assert same(got.select("id", "k", "n"), df.selectExpr("id", "k", number))


def test_equal_rows_are_numbered_and_share_a_range(spark):
    df = spark.range(300).selectExpr("if(id < 200, 7, id) AS v", "0 AS k")
    got = numbered_by_range(df, ["k"], [F.col("v")], "n", 10)
    assert sorted(r.n for r in got.collect()) == list(range(1, 301))
    assert {r.n for r in got.where("v = 7").collect()} == set(range(1, 201))
    empty = numbered_by_range(df.where("v < 0"), ["k"], [F.col("v")], "n", 10)
    assert empty.collect() == []


@pytest.mark.parametrize(
    "values",
    [
        # Names that share a long prefix, equal scores, one moment, and values far apart.
        ["concat('agent_with_a_long_name_', id)"],
        ["1.0D", "concat('a', id)"],
        ["TIMESTAMP '2024-01-01 00:00:00'", "id"],
        ["CAST(pow(10, id % 300) AS DOUBLE)", "id"],
    ],
)
def test_ranges_hold_about_as_many_rows_however_values_lie(spark, values):
    order = [F.expr(v) for v in values]
    assert most_in_a_range(spark.range(20_000).toDF("id"), order, 500) < 1500


def test_pair_means_come_from_one_reading(spark, bronze):
    from turnlake.operators.gold import match_totals
    from turnlake.plans.report import match_outliers

    got = match_outliers(match_totals(bronze))
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and "Generate" not in plan


def test_pair_means_of_matches_without_a_name(spark):
    from turnlake.plans.report import match_outliers

    rows = [("m1", "A", None, "b", 4, 2), ("m2", "A", None, "b", 1, 1), ("m3", "A", "a", "b", 0, 0)]
    totals = spark.createDataFrame(
        rows, "match_id string, seat string, player string, opponent string, payoff long, n_payoff long"
    )
    got = {r.match_id: (r.score_match, r.ecart) for r in match_outliers(totals).collect()}
    assert got["m3"] == (None, None) and got["m1"][0] == 2.0
    assert abs(got["m1"][1] - 1 / 3) < 1e-9 and abs(got["m2"][1] + 2 / 3) < 1e-9


def test_unknown_moves_types_and_opponents_stay(spark):
    from turnlake.operators.bronze import payoff_join
    from turnlake.plans.catalog import append_relaxed

    rows = [{**r, "player_type": t} for t in (None, "human") for r in seat_rows(f"n{t}", "C", "D")]
    for r in seat_rows("m", "CC", "DC"):  # a move X in the second turn
        odd = {("A", 2): {"move": "X"}, ("B", 2): {"opponent_move": "X"}}
        rows.append({**r, **odd.get((r["seat"], r["turn"]), {})})
    turns = log(spark, rows)
    joined = payoff_join(turns.drop("payoff", "opponent_payoff"))
    assert joined.count() == len(rows) and joined.where("payoff IS NULL").count() == 2
    fact = gold.fct_turns(enrich(turns), seed_agents(spark))
    assert sum(r.failures for r in accepted_values_tests(fact).collect()) > 0
    assert append_relaxed(turns).count() == len(rows)


def test_schedules_of_very_many_repeats_stay_small(spark):
    agents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "idx long, agent_name string")
    planned = schedule.schedule(agents, 10, 400_000_000, limit=3)
    first = [r.match_id for r in schedule.first_matches(planned, 3).collect()]
    assert first == [f"a__vs__a__t10__r{r}" for r in (1, 2, 3)]
    assert schedule.schedule(agents, 10, 250_000).count() == 6 * 250_000
    for limit in (1, 4, 7):
        whole = schedule.first_matches(schedule.schedule(agents, 10, 2), limit).collect()
        assert schedule.first_matches(schedule.schedule(agents, 10, 2, limit), limit).collect() == whole


def test_schedule_pairs_every_agent_with_itself_and_later_ones(spark):
    rows = [r for a in AGENTS for r in seat_rows("m", "C", "C", a=a, b=a)]
    turns = log(spark, [*rows, *seat_rows("m", "C", "C", a="zz", b="aa")])
    agents = schedule.agent_order(turns)
    assert same(agents, schedule.agent_order(turns, range_rows=2))
    order = [*AGENTS, "aa", "zz"]
    assert [r.agent_name for r in agents.orderBy("idx").collect()] == order
    planned = schedule.schedule(agents, 100, 3)
    expected = [
        f"{a}__vs__{b}__t100__r{r}"
        for a, b in itertools.combinations_with_replacement(order, 2)
        for r in (1, 2, 3)
    ]
    assert sorted(r.match_id for r in planned.collect()) == sorted(expected)
    first = schedule.first_matches(planned, 10).collect()
    assert [r.match_id for r in first] == expected[:10]


def test_pending_matches(spark):
    rows = seat_rows("a__vs__a__t1__r1", "C", "C", a="a", b="a")
    turns = log(spark, rows + seat_rows("a__vs__b__t1__r2", "C", "C", a="a", b="b"))
    planned = schedule.schedule(schedule.agent_order(turns), 1, 2)
    assert {r.match_id for r in schedule.pending(planned, turns).collect()} == {
        "a__vs__a__t1__r2",
        "a__vs__b__t1__r1",
        "b__vs__b__t1__r1",
        "b__vs__b__t1__r2",
    }


def test_sample_is_the_same_in_any_process(spark, bronze):
    ids = [r.match_id for r in bronze.select("match_id").distinct().collect()]
    kept = {i for i in ids if zlib.crc32(f"7:{i}".encode()) % 3 < 1}
    got = schedule.sample_matches(bronze, 7, 1, 3)
    assert {r.match_id for r in got.select("match_id").distinct().collect()} == kept
    assert got.count() == bronze.where(F.col("match_id").isin(kept)).count()


def test_missing_log_holds_no_match(spark, tmp_path):
    assert turn_log.existing_match_ids(spark, str(tmp_path / "none")).count() == 0


def test_overwrite_and_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    first, second = (log(spark, random_rows(s)) for s in (1, 2))
    turn_log.overwrite(first, path)
    turn_log.overwrite(second, path)
    assert same(turn_log.scan_turns(spark, path), second)
    ids = turn_log.existing_match_ids(spark, path)
    assert same(ids, second.select("match_id").distinct())
    assert turn_log.typed(second).schema["played_at"].dataType.typeName() == "timestamp"


def test_append_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = random_rows(4)
    some = [r for r in rows if r["match_id"] in ("m0", "m1", "m2")]
    turn_log.append_unseen(log(spark, some), path, "first")
    turn_log.append_unseen(log(spark, rows), path, "second")
    turn_log.append_unseen(log(spark, rows), path, "third")
    assert same(turn_log.scan_turns(spark, path), log(spark, rows))


def test_copies_within_a_load_count_once(spark, tmp_path):
    rows = random_rows(8)
    turn_log.append_unseen(log(spark, rows + rows[:7] * 50), str(tmp_path / "log"), "a")
    assert same(turn_log.scan_turns(spark, str(tmp_path / "log")), log(spark, rows))


def test_repeating_a_load_repairs_it(spark, tmp_path):
    path = str(tmp_path / "log")
    turn_log.append_unseen(log(spark, seat_rows("old", "CD", "DD")), path, "load-0")
    rows = random_rows(4)
    # What a load that died half-way may leave: some turns of a match.
    turn_log.write_load(log(spark, rows[:5]), path, "load-1")
    turn_log.append_unseen(log(spark, rows), path, "load-1")
    turn_log.append_unseen(log(spark, rows), path, "load-1")
    got = turn_log.scan_turns(spark, path)
    assert same(got, log(spark, rows + seat_rows("old", "CD", "DD")))


def test_append_takes_logs_with_other_columns(spark, tmp_path):
    path = str(tmp_path / "log")
    old = log(spark, seat_rows("old", "CD", "DD")).drop("raw_output", "run_id")
    new = log(spark, seat_rows("new", "CD", "DD")).withColumn("payoff", F.col("payoff").cast("short"))
    turn_log.append_unseen(old.withColumn("extra", F.lit(1)), path, "a")
    turn_log.append_unseen(new, path, "b")
    got = turn_log.scan_turns(spark, path)
    assert got.schema == TURNS
    assert got.count() == 8 and got.where("run_id IS NULL").count() == 4
    assert same(got, turn_log.union_relaxed(old, new))


def test_append_after_overwrite_reads_both(spark, tmp_path):
    path = str(tmp_path / "log")
    first, second = seat_rows("a", "CD", "DD"), seat_rows("b", "CD", "DD")
    turn_log.overwrite(log(spark, first), path)
    turn_log.append_unseen(log(spark, second), path, "x")
    assert same(turn_log.scan_turns(spark, path), log(spark, first + second))
    assert {r.match_id for r in turn_log.existing_match_ids(spark, path).collect()} == {"a", "b"}
    turn_log.overwrite(log(spark, second), path)
    assert same(turn_log.scan_turns(spark, path), log(spark, second))


def test_files_beside_load_folders_are_an_error(spark, tmp_path):
    path = str(tmp_path / "log")
    log(spark, seat_rows("a", "C", "D")).write.parquet(path)
    assert turn_log.scan_turns(spark, path).count() == 2
    turn_log.append_unseen(log(spark, seat_rows("b", "C", "D")), path, "x")
    with pytest.raises(ValueError, match="both files and load folders"):
        turn_log.scan_turns(spark, path)


def test_late_turns_of_a_match_come_in(spark, tmp_path):
    path, rows = str(tmp_path / "log"), seat_rows("m", "CDCD", "DDCC")
    turn_log.append_unseen(log(spark, [r for r in rows if r["turn"] < 3]), path, "a")
    turn_log.append_unseen(log(spark, [r for r in rows if r["turn"] > 1]), path, "b")
    assert same(turn_log.scan_turns(spark, path), log(spark, rows))


def test_a_new_checkpoint_under_an_old_name_loses_nothing(spark, tmp_path):
    path, rows = str(tmp_path / "log"), []
    for name in ("a", "b"):
        new = seat_rows(name, "CD", "DD")
        log(spark, new).write.parquet(str(tmp_path / f"in-{name}"))
        load_arrivals(
            spark, str(tmp_path / f"in-{name}"), path, str(tmp_path / f"ck-{name}"), "same"
        ).awaitTermination()
        rows += new
    assert same(turn_log.scan_turns(spark, path), log(spark, rows))


def test_changed_events_make_a_new_log(spark, tmp_path):
    events = stage.events(spark, FOLDER)
    events.write.parquet(str(tmp_path / "events.parquet"))
    first = stage.bronze(spark, str(tmp_path)).count()
    events.where("user_id % 2 = 0").write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
    assert stage.bronze(spark, str(tmp_path)).count() < first


def test_turns_without_an_id_load_once(spark, tmp_path):
    rows = [{**r, "match_id": None} for r in seat_rows("m", "CD", "DD")]
    for load in ("a", "b"):
        turn_log.append_unseen(log(spark, rows), str(tmp_path / "log"), load)
    assert turn_log.scan_turns(spark, str(tmp_path / "log")).count() == 4


def test_stream_loads_each_match_once(spark, tmp_path):
    arrivals, path = str(tmp_path / "in"), str(tmp_path / "log")
    rows = random_rows(6)

    def run() -> None:
        load_arrivals(spark, arrivals, path, str(tmp_path / "ck"), "s").awaitTermination()

    log(spark, [r for r in rows if r["match_id"] < "m5"]).write.parquet(arrivals)
    run()
    log(spark, rows).write.mode("append").parquet(arrivals)
    run()
    run()
    assert same(turn_log.scan_turns(spark, path), log(spark, rows))


def test_seed_csv_reads_like_the_built_in_table(spark, tmp_path):
    path = tmp_path / "seed.csv"
    lines = [",".join(SEED.names)] + [",".join(v or "" for v in row) for row in AGENT_META]
    path.write_text("\n".join(lines) + "\n")
    built_in, from_file = seed_agents(spark), seed_agents(spark, str(path))
    assert from_file.schema == SEED
    assert [(f.name, f.dataType) for f in built_in.schema] == [
        (f.name, f.dataType) for f in SEED
    ]
    assert same(built_in, from_file)
    assert {tuple(r) for r in built_in.collect()} == set(AGENT_META)


def test_layers(spark, tmp_path):
    turn_log.overwrite(spark.range(5).selectExpr("id", "id * 2 AS twice"), str(tmp_path / "in"))
    view = as_view(spark, "staging_test", "v", ["twice"], str(tmp_path / "in"))
    assert view.columns == ["twice"] and view.count() == 5
    for expected in (5, 3):
        table = as_table(spark.range(expected), "marts_test", "t", str(tmp_path))
        assert table.count() == expected
    assert len(list((tmp_path / "marts_test" / "t").iterdir())) == 1
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        as_table(spark.range(3).selectExpr("1 div (id - 2) AS id"), "marts_test", "t", str(tmp_path))
    assert spark.table("marts_test.t").count() == 3
    drop_tables(spark, "marts_test", ["t"])


def test_shuffle_width_follows_the_input(spark, tmp_path, monkeypatch):
    gib, tib = 1 << 30, 1 << 40
    assert sizing.settings(gib, 200) == {}
    assert sizing.settings(300 * gib, 200) == {sizing.INITIAL_PARTITIONS: "2400"}
    assert sizing.settings(300 * gib, 2400) == {}
    assert sizing.settings(300 * gib, 200, gib) == {sizing.INITIAL_PARTITIONS: "300"}
    assert sizing.settings(100 * tib, 200) == {sizing.INITIAL_PARTITIONS: "819200"}
    path = str(tmp_path / "log")
    turn_log.overwrite(spark.range(1000), path)
    monkeypatch.setattr(sizing, "PARTITION_BYTES", 100)
    assert spark.conf.get(sizing.INITIAL_PARTITIONS, None) is None
    with sizing.sized_for(spark, path):
        assert int(spark.conf.get(sizing.INITIAL_PARTITIONS)) >= 10
    assert spark.conf.get(sizing.INITIAL_PARTITIONS, None) is None
