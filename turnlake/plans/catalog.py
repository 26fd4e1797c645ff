"""Every query by name, as a function of a session and an input folder.

All read the whole turn log that is derived from the folder's events. Results that sum
doubles, whose last digits depend on the order of rows, are rounded to nine digits here.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from functools import cached_property, reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.operators import answers, bronze, fidelity, gold, quality, schedule, silver
from turnlake.operators.match_counts import distinct_matches
from turnlake.plans import pipeline, report
from turnlake.schemas import AGENTS, SILVER, TURN_KEY
from turnlake.sources import stage, turn_log
from turnlake.sources.decisions import paired_decisions
from turnlake.sources.folders import checkpoint_folder, remove, remove_at_end
from turnlake.sources.layers import as_table
from turnlake.sources.match_state import update_match_state
from turnlake.sources.seed import seed_agents
from turnlake.streaming.ingest import load_arrivals

SCHEDULE_TURNS = 33
SCHEDULE_LIMIT = 12
SAMPLE_SEED = 42
HEAT_MAP_WIDTH = 4
SHOWN_AGENTS = ["tit_for_tat", "grim_trigger", "persona_calculateur"]


class Layers:
    """The lazy plans that queries share, over one input folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    @cached_property
    def paired(self) -> DataFrame:
        return paired_decisions(stage.events(self.spark, self.folder))

    @cached_property
    def bronze_path(self) -> str:
        return stage.bronze_path(self.spark, self.folder)

    @cached_property
    def bronze(self) -> DataFrame:
        return turn_log.scan_turns(self.spark, self.bronze_path)

    @cached_property
    def seed(self) -> DataFrame:
        return seed_agents(self.spark)

    @cached_property
    def silver(self) -> DataFrame:
        return silver.enrich(self.bronze)

    @cached_property
    def dim(self) -> DataFrame:
        return gold.dim_agent(self.bronze, self.seed)

    @cached_property
    def fact(self) -> DataFrame:
        return gold.fct_turns(silver.staged(self.silver), self.seed)

    @cached_property
    def plays(self) -> DataFrame:
        """Totals that need no history, straight from the log."""
        return gold.match_totals(self.bronze)

    @cached_property
    def totals(self) -> DataFrame:
        return gold.match_totals(self.silver)

    @cached_property
    def board(self) -> DataFrame:
        return rounded(gold.leaderboard(self.totals, self.seed), "temps_moyen_reponse_s")

    @cached_property
    def matchup(self) -> DataFrame:
        return gold.matchup_matrix(self.plays)

    @cached_property
    def coop_time(self) -> DataFrame:
        return gold.coop_over_time(self.bronze)

    @cached_property
    def versus(self) -> DataFrame:
        return gold.llm_vs_coded(self.board, self.seed)

    @cached_property
    def reciprocity(self) -> DataFrame:
        return gold.reciprocity(self.totals)

    @cached_property
    def expected(self) -> DataFrame:
        return fidelity.expected_move(gold.with_equivalents(self.bronze, self.seed))

    @cached_property
    def followed(self) -> DataFrame:
        return fidelity.fidelity_totals(self.expected)

    @cached_property
    def fidelity(self) -> DataFrame:
        return fidelity.persona_fidelity(self.followed)

    @cached_property
    def fidelity_opp(self) -> DataFrame:
        return fidelity.fidelity_by_opponent(self.followed)

    def schedule(self, limit: int | None = None) -> DataFrame:
        repeats = self.bronze.agg(F.max("repeat")).scalar()
        agents = schedule.agent_order(self.bronze)
        return schedule.schedule(agents, SCHEDULE_TURNS, repeats, limit)

    @cached_property
    def scheduled(self) -> DataFrame:
        return self.schedule()


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def keyed(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.select(*TURN_KEY, *columns)


def append_relaxed(turns: DataFrame) -> DataFrame:
    """A log that lacks the model columns, with one of model-played seats."""
    rules = turns.where("NOT player_type <=> 'llm'").drop("response_time", "raw_output")
    return turn_log.union_relaxed(rules, turns.where("player_type = 'llm'"))


def incremental_load(turns: DataFrame) -> DataFrame:
    """What a load of the whole log adds to a log that holds the first repeats."""
    return turn_log.unseen(turns, turns.where("repeat = 1"))


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows as written beside the staged log, until the application ends."""
    path = f"{checkpoint_folder(df.sparkSession)}/turnlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_match(turns: DataFrame) -> DataFrame:
    return turns.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("payoff").alias("payoff")
    )


def in_scratch_log(layers: Layers, load: Callable[[str], None]) -> DataFrame:
    """Counts per match of a log that ``load`` writes; the log itself goes at once."""
    spark = layers.spark
    target = f"{checkpoint_folder(spark)}/turnlake/loads-{uuid.uuid4().hex}"
    try:
        load(target)
        return kept(per_match(turn_log.scan_turns(spark, f"{target}/bronze")), "loaded")
    finally:
        remove(spark, target)


def stream_load(layers: Layers) -> DataFrame:
    """The log read as arriving files and loaded twice; the second load adds nothing."""

    def load(target: str) -> None:
        for number in ("first", "second"):
            load_arrivals(
                layers.spark, layers.bronze_path, f"{target}/bronze", f"{target}/{number}", "s"
            ).awaitTermination()

    return in_scratch_log(layers, load)


def append_after_overwrite(layers: Layers) -> DataFrame:
    """A log written whole from the first repeats, and then extended by the whole log."""

    def load(target: str) -> None:
        turn_log.overwrite(layers.bronze.where("repeat = 1"), f"{target}/bronze")
        turn_log.append_unseen(layers.bronze, f"{target}/bronze", "all")

    return in_scratch_log(layers, load)


def late_turns(layers: Layers) -> DataFrame:
    """A log whose matches arrive in two loads, odd turns first."""

    def load(target: str) -> None:
        for number, turns in (("odd", "turn % 2 = 1"), ("even", "turn % 2 = 0")):
            turn_log.append_unseen(layers.bronze.where(turns), f"{target}/bronze", number)

    return in_scratch_log(layers, load)


def rebuild_after_failure(layers: Layers) -> DataFrame:
    """Counts per match of a log while a rebuild of it has died, and after one that worked."""
    spark, bronze = layers.spark, layers.bronze
    target = f"{checkpoint_folder(spark)}/turnlake/loads-{uuid.uuid4().hex}"
    dying = F.expr("if(turn > 1, CAST(raise_error('the rebuild dies') AS INT), payoff)")
    try:
        turn_log.overwrite(bronze.where("repeat = 1"), target)
        with suppress(PySparkException):
            turn_log.overwrite(bronze.withColumn("payoff", dying), target)
        after = kept(per_match(turn_log.scan_turns(spark, target)), "died")
        turn_log.overwrite(bronze, target)
        rebuilt = kept(per_match(turn_log.scan_turns(spark, target)), "rebuilt")
    finally:
        remove(spark, target)
    states = (("died", after), ("rebuilt", rebuilt))
    return reduce(DataFrame.unionByName, [df.withColumn("state", F.lit(n)) for n, df in states])


def concurrent_loads(layers: Layers) -> DataFrame:
    """A log that two loads, which share half of their turns, extend at once."""

    def load(target: str) -> None:
        parts = {"low": "turn % 4 < 3", "high": "turn % 4 > 0"}
        with ThreadPoolExecutor(len(parts)) as pool:
            loads = [
                pool.submit(
                    turn_log.append_unseen, layers.bronze.where(turns), f"{target}/bronze", name
                )
                for name, turns in parts.items()
            ]
            for each in loads:
                each.result()

    return in_scratch_log(layers, load)


def compacted_log(layers: Layers) -> DataFrame:
    """A log of three loads that is folded into one, one of them repeated after that."""

    def load(target: str) -> None:
        for k in (0, 1, 2, 1):
            part = layers.bronze.where(f"turn % 3 = {k}")
            turn_log.append_unseen(part, f"{target}/bronze", f"load-{k}")
            if k == 2:
                turn_log.compact(layers.spark, f"{target}/bronze")

    return in_scratch_log(layers, load)


def silver_by_load(layers: Layers) -> DataFrame:
    """Silver brought up load by load, with new matches in the second and late turns in the third."""
    spark = layers.spark
    target = f"{checkpoint_folder(spark)}/turnlake/loads-{uuid.uuid4().hex}"
    parts = ["repeat = 1 AND turn % 5 > 0", "repeat > 1", "repeat = 1 AND turn % 5 = 0"]
    try:
        for k, turns in enumerate(parts):
            turn_log.append_unseen(layers.bronze.where(turns), f"{target}/bronze", f"load-{k}")
            rows = pipeline.update_silver(spark, f"{target}/bronze", f"{target}/silver")
        return kept(rows, "silver")
    finally:
        remove(spark, target)


def match_counts_by_load(layers: Layers) -> DataFrame:
    """Distinct matches per pair, per agent and of the log, from bitmaps that three loads add to.

    The third load brings late turns of matches that the first one numbered.
    """
    spark = layers.spark
    target = f"{checkpoint_folder(spark)}/turnlake/loads-{uuid.uuid4().hex}"
    parts = ["repeat = 1 AND turn % 5 > 0", "repeat > 1", "repeat = 1 AND turn % 5 = 0"]
    try:
        for k, turns in enumerate(parts):
            turn_log.append_unseen(layers.bronze.where(turns), f"{target}/bronze", f"load-{k}")
            bitmaps = update_match_state(spark, f"{target}/bronze", f"{target}/matches")
        bitmaps = kept(bitmaps, "matches")
    finally:
        remove(spark, target)
    grains = {"pair": ["player", "opponent"], "agent": ["player"], "log": []}
    parts = []
    for grain, keys in grains.items():
        absent = {c: F.lit(None).cast("string") for c in grains["pair"] if c not in keys}
        counts = distinct_matches(bitmaps, keys).withColumns({**absent, "grain": F.lit(grain)})
        parts.append(counts.select("grain", "player", "opponent", "n_matches"))
    return reduce(DataFrame.unionByName, parts)


def typed_turns(turns: DataFrame) -> DataFrame:
    """The typed view, its timestamp shown as seconds."""
    return keyed(turn_log.typed(turns), F.unix_timestamp("played_at").alias("played_at_s"))


def mart_read_back(layers: Layers) -> DataFrame:
    """The matchup mart rebuilt as a table and read back through a view."""
    root = f"{checkpoint_folder(layers.spark)}/turnlake/marts-{uuid.uuid4().hex}"
    remove_at_end(layers.spark, root)
    table = as_table(layers.matchup, "turnlake_check", "matchup", root)
    return kept(table, "matchup")


def presented_marts(layers: Layers) -> DataFrame:
    """Each mart's rows by their place in the order of presentation.

    Numbering reads a mart several times, so the marts are written first, as the pipeline does.
    """
    marts = {
        "agg_agent_leaderboard": (layers.board, ["agent"]),
        "agg_matchup_matrix": (layers.matchup, ["player", "opponent"]),
        "agg_cooperation_over_time": (layers.coop_time, ["agent", "agent_type", "turn"]),
        "agg_persona_fidelity": (layers.fidelity, ["persona"]),
        "agg_persona_fidelity_by_opponent": (layers.fidelity_opp, ["persona", "opponent"]),
        "agg_reciprocity": (layers.reciprocity, ["agent", "agent_type"]),
    }
    parts = [report.placed(kept(mart, name), name, row) for name, (mart, row) in marts.items()]
    return reduce(DataFrame.unionByName, parts)


def match_sample(turns: DataFrame) -> DataFrame:
    """About one match in four, always the same ones."""
    kept = schedule.sample_matches(turns, SAMPLE_SEED, 1, 4)
    return kept.groupBy("match_id").agg(F.count(F.lit(1)).alias("n_rows"))


def match_replay(layers: Layers) -> DataFrame:
    match = report.default_match(layers.bronze).scalar()
    return report.match_replay(layers.silver, match)


def match_from_log(layers: Layers) -> DataFrame:
    """The replay of a match that is looked up in a written silver log of two loads."""
    spark = layers.spark
    target = f"{checkpoint_folder(spark)}/turnlake/loads-{uuid.uuid4().hex}"
    match = report.default_match(layers.bronze).first()[0]
    try:
        for load, turns in (("first", "repeat = 1"), ("rest", "NOT repeat <=> 1")):
            turn_log.append_unseen(layers.bronze.where(turns), f"{target}/bronze", load)
            pipeline.update_silver(spark, f"{target}/bronze", f"{target}/silver")
        found = turn_log.scan_match(spark, f"{target}/silver", match, SILVER)
        return kept(report.match_replay(found, F.lit(match)), "match")
    finally:
        remove(spark, target)


QUERIES: dict[str, Callable[[Layers], DataFrame]] = {
    # Sources and loading
    "scan_turns": lambda x: x.bronze,
    "existing_match_ids": lambda x: turn_log.existing_match_ids(x.spark, x.bronze_path),
    "append_relaxed": lambda x: append_relaxed(x.bronze),
    "incremental_load": lambda x: incremental_load(x.bronze),
    "stream_load": stream_load,
    "append_after_overwrite": append_after_overwrite,
    "late_turns": late_turns,
    "rebuild_after_failure": rebuild_after_failure,
    "concurrent_loads": concurrent_loads,
    "compacted_log": compacted_log,
    "silver_by_load": silver_by_load,
    "match_counts_by_load": match_counts_by_load,
    "typed_turns": lambda x: typed_turns(x.bronze),
    "mart_read_back": mart_read_back,
    # Relation builders
    "match_schedule": lambda x: x.scheduled,
    "match_schedule_limit": lambda x: schedule.first_matches(
        x.schedule(SCHEDULE_LIMIT), SCHEDULE_LIMIT
    ),
    "pending_matches": lambda x: schedule.pending(x.scheduled, x.bronze),
    "pending_repeats": lambda x: schedule.pending_repeats(x.scheduled, x.bronze),
    "match_sample": lambda x: match_sample(x.bronze),
    "tidy_seats": lambda x: bronze.tidy_seats(x.paired),
    "payoff_join": lambda x: keyed(
        bronze.payoff_join(bronze.tidy_seats(x.paired)),
        "move",
        "opponent_move",
        "payoff",
        "opponent_payoff",
    ),
    # Silver
    "silver_turns": lambda x: x.silver,
    "stg_turns": lambda x: silver.staged(x.silver),
    "cum_scores": lambda x: keyed(x.silver, "own_cum_score", "opp_cum_score"),
    "coop_rates": lambda x: keyed(x.silver, "own_coop_rate", "opp_coop_rate"),
    "opponent_last_move": lambda x: keyed(x.silver, "opponent_last_move"),
    "defection_streak": lambda x: keyed(x.silver, "opponent_defection_streak"),
    "forgave_retaliated": lambda x: keyed(
        x.silver, "forgave_this_turn", "retaliated_this_turn"
    ),
    "round_outcome": lambda x: keyed(x.silver, "round_outcome"),
    "history_summary": lambda x: silver.history_summaries(x.bronze),
    # Model answers
    "parse_move_json": lambda x: keyed(answers.stage_moves(x.bronze), "json_move"),
    "parse_move_letter": lambda x: keyed(answers.stage_moves(x.bronze), "letter_move"),
    "parse_move_keyword": lambda x: keyed(answers.stage_moves(x.bronze), "keyword_move"),
    "extract_move": lambda x: answers.reparsed(x.bronze),
    "parse_audit": lambda x: answers.parse_audit(x.bronze),
    "justification_rate": lambda x: answers.justification_rate(x.bronze),
    "payload_schema_audit": lambda x: answers.payload_audit(x.bronze),
    # Gold
    "dim_agent": lambda x: x.dim,
    "fct_turns": lambda x: x.fact,
    "turn_key": lambda x: keyed(x.fact, "turn_key"),
    "grim_state": lambda x: keyed(
        fidelity.grim_state(x.bronze.where("player_type = 'llm'")), "opp_defected_before"
    ),
    "expected_move": lambda x: keyed(
        x.expected, "player", "opponent", "player_coded_equivalent", "move", "expected_move"
    ),
    "leaderboard": lambda x: x.board,
    "matchup_matrix": lambda x: x.matchup,
    "coop_over_time": lambda x: x.coop_time,
    "llm_vs_coded": lambda x: x.versus,
    "persona_fidelity": lambda x: x.fidelity,
    "fidelity_by_opponent": lambda x: x.fidelity_opp,
    "reciprocity": lambda x: x.reciprocity,
    "outcome_counts": lambda x: gold.outcome_counts(x.plays),
    "silver_stats": lambda x: gold.silver_stats(x.plays),
    # Report
    "report_kpis": lambda x: report.kpis(x.plays, x.board),
    "report_extremes": lambda x: report.extremes(x.board),
    "reciprocity_score_corr": lambda x: rounded(
        report.reciprocity_score_corr(x.reciprocity), "correlation"
    ),
    "strict_fidelity": lambda x: report.strict_fidelity(x.fidelity),
    "coop_phases": lambda x: rounded(
        report.coop_phases(x.coop_time), "coop_debut", "coop_fin", "derive"
    ),
    "coop_drift": lambda x: rounded(report.coop_drift(x.coop_time, x.board), "derive"),
    "coop_filtered": lambda x: report.coop_filtered(x.coop_time, SHOWN_AGENTS),
    "agent_list": lambda x: report.agent_list(x.bronze),
    "match_list": lambda x: report.match_list(x.bronze),
    "default_match": lambda x: report.default_match(x.bronze),
    "match_replay": match_replay,
    "match_from_log": match_from_log,
    "move_sequence": lambda x: report.move_sequence(x.bronze),
    "matchup_pivot": lambda x: report.matchup_pivot(x.matchup, AGENTS),
    "matchup_heat_map": lambda x: report.heat_map_cells(
        report.heat_map_rows(x.matchup, HEAT_MAP_WIDTH)
    ),
    "presented_marts": presented_marts,
    "fidelity_heatmap": lambda x: report.fidelity_heatmap(x.fidelity_opp),
    "llm_vs_coded_gap": lambda x: report.persona_gaps(x.versus),
    "coop_unpivot": lambda x: report.coop_unpivot(x.versus),
    "repeat_stddev": lambda x: rounded(report.repeat_stddev(x.plays), "ecart_type"),
    "rank_delta": lambda x: report.rank_delta(x.plays),
    "match_outliers": lambda x: report.match_outliers(x.plays),
    "parse_reliability": lambda x: report.parse_reliability(x.plays),
    # Data tests
    "dq_not_null": lambda x: quality.not_null_tests(x.fact, x.dim, x.fidelity, x.silver),
    "dq_unique": lambda x: quality.unique_tests(x.fact, x.dim, x.fidelity),
    "dq_accepted_values": lambda x: quality.accepted_values_tests(x.fact),
    "dq_relationships": lambda x: quality.relationship_tests(x.fact, x.dim),
    "dq_accepted_range": lambda x: quality.range_tests(x.fidelity),
    "dq_all": lambda x: quality.all_tests(x.fact, x.dim, x.fidelity, x.silver),
    "dq_payoff_matrix": lambda x: bronze.payoff_matrix_check(x.bronze),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(build: Callable[[Layers], DataFrame]):
        return lambda spark, folder: build(Layers(spark, folder))

    return {name: bound(build) for name, build in QUERIES.items()}
