"""Whole pipeline, agreement with SQL, and the shape of the plans."""

from __future__ import annotations

import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import FOLDER
from games import log, random_rows, seat_rows
from turnlake.operators import gold
from turnlake.operators.silver import enrich
from turnlake.plans import catalog, pipeline, report
from turnlake.sources import stage, turn_log

import __spark_entry__ as entry_module

ORACLE = {k: v for k, v in entry_module.oracle_sql().items() if k in catalog.QUERIES}
# Operators that no plan may hold: pairings without a key, and Python workers.
OUTSIDE = ["CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"]
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(ORACLE)


LOADS = {
    "stream_load",
    "append_after_overwrite",
    "late_turns",
    "mart_read_back",
    "presented_marts",
    "match_from_log",
    "rebuild_after_failure",
    "concurrent_loads",
    "compacted_log",
    "silver_by_load",
    "match_counts_by_load",
}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - LOADS))
def test_planning_runs_no_job(spark, name):
    stage.bronze_path(spark, FOLDER)
    context = spark.sparkContext
    context.setJobGroup(f"plan-{name}", name)
    catalog.queries()[name](spark, FOLDER)._jdf.queryExecution().analyzed()
    context.setLocalProperty("spark.jobGroup.id", None)
    # Two queries start from the events, whose columns Spark reads from a file's footer.
    footers = name in ("tidy_seats", "payoff_join")
    assert len(context.statusTracker().getJobIdsForGroup(f"plan-{name}")) == footers


@pytest.mark.parametrize("name", ORACLE)
def test_query_agrees_with_sql(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [operator for operator in OUTSIDE if operator in plan]
    relation = duck.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    order = [relation.columns.index(c) for c in columns]
    expected = sorted(repr(tuple(row[i] for i in order)) for row in relation.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == expected


def test_entry(spark):
    assert entry_module.entry(spark).count() == 8


def test_pipeline_writes_what_the_queries_compute(spark, tmp_path):
    bronze = stage.bronze_path(spark, FOLDER)
    silver = pipeline.build_silver(spark, bronze, str(tmp_path / "silver"))
    for _ in range(2):  # a rebuild replaces the tables
        tables = pipeline.build_gold(spark, str(tmp_path / "silver"), str(tmp_path / "gold"))
    names = {
        "fct_turns": "fct_turns",
        "dim_agent": "dim_agent",
        "agg_agent_leaderboard": "leaderboard",
        "agg_matchup_matrix": "matchup_matrix",
        "agg_cooperation_over_time": "coop_over_time",
        "agg_llm_vs_coded": "llm_vs_coded",
        "agg_persona_fidelity": "persona_fidelity",
        "agg_persona_fidelity_by_opponent": "fidelity_by_opponent",
        "agg_reciprocity": "reciprocity",
    }
    assert set(tables) == set(names)
    for table, query in names.items():
        built = tables[table]
        if "temps_moyen_reponse_s" in built.columns:
            built = catalog.rounded(built, "temps_moyen_reponse_s")
        direct = catalog.queries()[query](spark, FOLDER)
        assert built.columns == direct.columns
        assert built.exceptAll(direct).isEmpty() and direct.exceptAll(built).isEmpty(), table
    tests = pipeline.run_tests(silver, tables).collect()
    assert len(tests) == 13 and all(r.failures == 0 for r in tests)
    assert spark.table("staging.stg_turns").count() == silver.count()
    for schema in ("staging", "marts"):
        spark.sql(f"DROP SCHEMA {schema} CASCADE")


def executed(df) -> str:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def test_silver_shuffles_and_sorts_once(spark, bronze):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = executed(enrich(bronze))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert len(re.findall(r"Sort \[", plan)) == 1
    assert "Join" not in plan


def test_long_matches_add_no_shuffle_or_sort_of_the_log(spark, bronze):
    """The log is shuffled and sorted once.

    The block starts take three shuffles, and two more that find undeclared long matches.
    """
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    old = {key: spark.conf.get(key) for key in keys}
    for key, value in zip(keys, ["-1", "false"]):
        spark.conf.set(key, value)
    try:
        plan = enrich(bronze, 10)._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    log_side, _, start_side = plan.partition("SortMergeJoin")[2].rpartition("\n      +- ")
    assert "Window [" in log_side and "Window [" in start_side
    for operator in ("Exchange hashpartitioning", "Sort ["):
        assert log_side.count(operator) == 1
        assert start_side.count(operator) <= 5


def test_block_starts_read_only_long_matches(bronze):
    plan = enrich(bronze)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[Or\(Or\(GreaterThan\(n_turns,100000\)", plan)


def test_gold_reads_the_written_leaderboard(spark, tmp_path, monkeypatch):
    seen = []
    real = gold.llm_vs_coded
    monkeypatch.setattr(gold, "llm_vs_coded", lambda board, seed: seen.append(board) or real(board, seed))
    pipeline.build_silver(spark, stage.bronze_path(spark, FOLDER), str(tmp_path / "silver"))
    pipeline.build_gold(spark, str(tmp_path / "silver"), str(tmp_path / "gold"))
    assert "Aggregate" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    for schema in ("staging", "marts"):
        spark.sql(f"DROP SCHEMA {schema} CASCADE")


def test_persona_filter_and_columns_reach_the_scan(spark):
    plan = catalog.queries()["persona_fidelity"](spark, FOLDER)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(player_type,llm)" in text
    assert "raw_output" not in text and "played_at" not in text


def test_match_filter_reaches_the_scan(spark, bronze):
    from pyspark.sql import functions as F

    plan = report.match_replay(enrich(bronze), F.lit("some_match"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(match_id,some_match)" in text


def test_move_sequence_in_segments(spark):
    turns = log(spark, seat_rows("G1", "CDCDCC", "DCDDCD"))
    whole = {(r.match_id, r.seat): r.sequence for r in report.move_sequence(turns).collect()}
    assert whole == {("G1", "A"): "CDCDCC", ("G1", "B"): "DCDDCD"}
    parts = report.move_sequence(turns, 4).where("seat = 'A'").orderBy("segment").collect()
    assert [r.sequence for r in parts] == ["CDCD", "CC"]


def test_default_match_without_personas(spark):
    turns = log(spark, seat_rows("m2", "C", "C") + seat_rows("m1", "C", "C"))
    assert report.default_match(turns).collect()[0].match_id == "m1"


def test_correlation_needs_three_agents(spark):
    rows = [("a", 0.5, 2.0), ("b", 0.1, 1.0), ("c", None, 9.0)]
    mart = spark.createDataFrame(rows, "agent string, reciprocite double, score_moyen_par_tour double")
    row = report.reciprocity_score_corr(mart).collect()[0]
    assert (row.n_agents, row.correlation) == (2, None)
    line = spark.createDataFrame([*rows, ("d", 0.3, 1.5)], mart.schema)
    assert abs(report.reciprocity_score_corr(line).collect()[0].correlation - 1) < 1e-9


def test_phases_drop_agents_without_late_turns(spark):
    rows = [("long", 1, 1.0), ("long", 30, 0.0), ("short", 1, 1.0), ("mid", 25, 0.5)]
    time = spark.createDataFrame(rows, "agent string, turn int, taux_cooperation double")
    got = report.coop_phases(time).collect()
    assert [(r.agent, r.coop_debut, r.coop_fin, r.derive) for r in got] == [("long", 1.0, 0.0, -1.0)]


def test_presentation_order(spark):
    rows = [("a", None), ("c", 0.5), ("b", 0.5), ("d", 0.9)]
    mart = spark.createDataFrame(rows, "agent string, reciprocite double").selectExpr(
        "*", "'coded' AS agent_type"
    )
    shown = report.presented(mart, "agg_reciprocity").collect()
    assert [r.agent for r in shown] == ["d", "b", "c", "a"]


def test_pivot_shows_agents_beyond_the_known_ones(spark):
    turns = log(spark, seat_rows("m", "CD", "DD", a="newcomer", b="random"))
    matrix = gold.matchup_matrix(gold.match_totals(turns))
    assert set(report.matchup_pivot(matrix).columns) == {"player", "newcomer", "random"}
    rows = {r.player: r for r in report.matchup_pivot(matrix, ["random"]).collect()}
    assert (rows["random"].n_others, rows["newcomer"].n_others) == (1, 0)


def test_pivot_keeps_the_scores_against_other_opponents(spark):
    rows = [("p", "random", 2.0), ("p", "b-c", 1.5), ("p", "b", 3.0), ("p", "d", None), ("p", None, 9.0), ("q", "random", 4.0)]
    mart = spark.createDataFrame(rows, "player string, opponent string, score_moyen_par_tour double")
    got = {r.player: r for r in report.matchup_pivot(mart, ["random"]).collect()}
    assert (got["p"].random, got["p"].others, got["p"].n_others) == (2.0, "b=3.0, b-c=1.5", 3)
    assert (got["q"].random, got["q"].others, got["q"].n_others) == (4.0, None, 0)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_heat_map_rows_hold_any_number_of_agents(spark, width):
    agents = [f"agent{k:03}" for k in range(40)]
    cells = {(a, b): (i * 7 + j) % 11 / 3 for i, a in enumerate(agents) for j, b in enumerate(agents) if (i + j) % 3}
    cells[agents[0], agents[1]] = None  # a pair without a gain
    rows = [(a, b, score) for (a, b), score in cells.items()] + [(None, "agent001", 1.0), ("agent001", None, 1.0)]
    mart = spark.createDataFrame(rows, "player string, opponent string, score_moyen_par_tour double")
    parts = report.heat_map_rows(mart, width, range_rows=5).collect()
    assert max(len(r.scores) for r in parts) <= width
    assert {(r.player, o): s for r in parts for o, s in r.scores.items()} == cells
    assert all(agents.index(o) // width == r.part for r in parts for o in r.scores)
    told = report.heat_map_cells(report.heat_map_rows(mart, width)).collect()
    assert {(r.player, r.opponent): r.score_moyen_par_tour for r in told} == cells
    assert report.heat_map_rows(mart.limit(0)).count() == 0


def test_strict_picks_ignore_missing_values(spark):
    rows = [("p", "stricte", 0.5, None), ("a", "stricte", 0.9, 0.4), ("b", "stricte", 0.9, 0.1), ("c", "souple", 1.0, 0.0), ("d", "stricte", None, 0.1)]
    mart = spark.createDataFrame(rows, "persona string, equivalence string, fidelite double, riposte_attendue_respectee double")
    shown = report.strict_fidelity(mart.withColumn("coded_equivalent", F.lit("r")))
    got = {r.persona: (r.is_most_faithful, r.is_least_retaliating) for r in shown.collect()}
    assert got == {"p": (False, False), "a": (True, False), "b": (False, True), "d": (False, False)}
    nothing = report.strict_fidelity(mart.where("persona = 'p'").withColumn("coded_equivalent", F.lit("r")))
    assert [(r.is_most_faithful, r.is_least_retaliating) for r in nothing.collect()] == [(True, False)]


def test_presentation_of_every_mart(spark):
    marts = {
        "agg_agent_leaderboard": ("agent string, score_moyen_par_tour double", [("b", 1.0), ("a", 1.0), ("c", None), ("d", 2.0)], "dabc"),
        "agg_matchup_matrix": ("player string, score_moyen_par_tour double, opponent string", [("y", 1.0, "b"), ("y", 2.0, "c"), ("x", None, "a"), ("x", 0.5, "d")], "dacb"),
        "agg_cooperation_over_time": ("agent string, turn int, agent_type string", [("a", 2, "r"), ("a", 1, "s"), ("a", 1, "q")], "qsr"),
        "agg_persona_fidelity": ("fidelite double, persona string", [(None, "z"), (0.2, "a"), (0.9, "b")], "baz"),
        "agg_persona_fidelity_by_opponent": ("persona string, fidelite double, opponent string", [("p", None, "z"), ("p", 0.9, "a"), ("p", 0.1, "c")], "caz"),
        "agg_reciprocity": ("reciprocite double, agent_type string, agent string", [(None, "t", "a"), (0.1, "t", "c"), (0.1, "t", "b")], "bca"),
    }
    assert set(marts) == set(report.PRESENTATION)
    for name, (schema, rows, order) in marts.items():
        shown = report.presented(spark.createDataFrame(rows, schema), name)
        label = {"agg_agent_leaderboard": "agent"}.get(name, shown.columns[-1])
        assert "".join(r[label] for r in shown.collect()) == order


def test_places_of_large_marts_are_numbered_in_blocks(spark):
    marts = {
        "agg_matchup_matrix": ("player string, score_moyen_par_tour double, opponent string", [("y", 1.0, "b"), ("y", 2.0, "c"), ("x", None, "a"), ("x", 0.5, "d"), (None, 3.0, "e")], "dacbe"),
        "agg_cooperation_over_time": ("agent string, turn int, agent_type string", [("b", 1, "t"), ("a", 250_000, "r"), ("a", 100_000, "s"), ("a", 99_999, "q"), ("a", None, "n"), (None, 1, "z")], "qsrntz"),
        "agg_persona_fidelity_by_opponent": ("persona string, fidelite double, opponent string", [("q", 0.0, "b"), ("p", None, "z"), ("p", 0.9, "a"), ("p", 0.1, "c")], "cazb"),
        "agg_reciprocity": ("reciprocite double, agent_type string, agent string", [(None, "t", "a"), (0.1, "t", "c"), (0.1, "t", "b")], "bca"),
    }
    for name, (schema, rows, order) in marts.items():
        mart = spark.createDataFrame(rows, schema)
        for range_rows in (1, 1000):
            places = report.placed(mart, name, [mart.columns[-1]], range_rows)
            assert sorted((r.place, r.row) for r in places.collect()) == list(enumerate(order, 1))
        windows = re.findall(r"row_number\(\)[^\n]*", places._jdf.queryExecution().analyzed().toString())
        assert windows and all("windowspecdefinition(_block" in w for w in windows)


def test_ranks_follow_score_then_name(spark):
    rows = []
    for repeat, moves in ((1, ("CC", "DD")), (2, ("DD", "CC"))):
        rows += seat_rows(f"m{repeat}", *moves, a="a", b="b", repeat=repeat)
    got = {r.agent: r for r in report.rank_delta(gold.match_totals(log(spark, rows))).collect()}
    assert (got["a"].rang_un, got["b"].rang_un) == (2, 1)
    assert (got["a"].rang_tous, got["b"].rang_tous) == (1, 2)
    assert (got["a"].delta_rang, got["a"].delta_score) == (-1, 2.5)


def test_totals_of_split_blocks_are_the_same(spark):
    turns = log(spark, random_rows(9, n_matches=20))
    a, b = (gold.match_totals(enrich(turns, n)) for n in (100_000, 3))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_staged_log_lies_in_the_checkpoint_folder(spark):
    path = stage.bronze_path(spark, FOLDER)
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert turn_log.scan_turns(spark, path).count() == 992
