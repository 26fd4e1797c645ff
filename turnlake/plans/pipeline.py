"""The layers in dependency order, each written once and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.operators import fidelity, gold, quality
from turnlake.operators.history import BLOCK_TURNS
from turnlake.operators.silver import enrich
from turnlake.schemas import SILVER, STAGING_COLUMNS, TURNS
from turnlake.sources import snapshots
from turnlake.sources.folders import remove
from turnlake.sources.key_index import recorded_runs
from turnlake.sources.layers import as_table, as_view
from turnlake.sources.match_state import match_state
from turnlake.sources.seed import seed_agents
from turnlake.sources.sizing import sized_for
from turnlake.sources.snapshots import Conflict, Entry
from turnlake.sources.turn_log import (
    BASE,
    TRIES,
    drop_entries,
    indexed,
    overwrite,
    read_entries,
    scan_turns,
    write_load,
)

STAGING = "staging"
MARTS = "marts"


def build_silver(
    spark: SparkSession, bronze: str, silver: str, block_turns: int = BLOCK_TURNS
) -> DataFrame:
    """Rebuild the silver log from the bronze one."""
    entries = snapshots.latest(spark, bronze).entries
    with sized_for(spark, bronze):
        turns = read_entries(spark, bronze, TURNS, entries)
        overwrite(enrich(turns, block_turns), silver, [e.folder for e in entries])
    return scan_turns(spark, silver, SILVER)


def update_silver(
    spark: SparkSession, bronze: str, silver: str, block_turns: int = BLOCK_TURNS
) -> DataFrame:
    """Bring the silver log up to the bronze one, at the cost of the matches that changed.

    Bronze folders that silver does not know yet are enriched into a folder of their own. Matches
    of theirs that silver holds already, as late turns make them, are found through its key index:
    they are computed anew from all their turns, and the folders that hold them are written without
    them. All other files stay. The rows are those of a full rebuild, which happens instead where
    bronze no longer has a folder that silver was built from.
    """
    for _ in range(TRIES):
        log, state = snapshots.latest(spark, bronze), snapshots.latest(spark, silver)
        present = [e.folder for e in log.entries]
        if not state.derived_from or not set(state.derived_from) <= set(present):
            return build_silver(spark, bronze, silver, block_turns)
        new = [e for e in log.entries if e.folder not in state.derived_from]
        if not new:
            break
        entries, made = _changed_folders(spark, bronze, silver, new, state.entries, block_turns)
        try:
            snapshots.publish(spark, silver, state.next(entries, present))
            break
        except Conflict:
            drop_entries(spark, silver, *made)
    else:
        raise Conflict(silver)
    return scan_turns(spark, silver, SILVER)


def _changed_folders(
    spark: SparkSession,
    bronze: str,
    silver: str,
    new: list[Entry],
    entries: list[Entry],
    block_turns: int,
) -> tuple[list[Entry], list[Entry]]:
    """(the silver log's folders with the new bronze folders in it, those of them made here)."""
    fresh = read_entries(spark, bronze, TURNS, new)
    entries = indexed(spark, silver, entries)
    runs = recorded_runs(fresh, silver, entries).withColumnRenamed("match_id", "_match")
    ids = fresh.select("match_id").distinct()
    late = runs.join(ids, F.expr("_match <=> match_id"), "left_semi").select("_match", "folder")
    scratch = f"{silver}/_late/{uuid.uuid4().hex}"
    late.distinct().write.parquet(scratch)
    late = spark.read.schema("_match string, folder string").parquet(scratch)
    hit = {r.folder for r in late.select("folder").distinct().collect()}
    ids, same = late.select("_match").distinct(), F.expr("match_id <=> _match")

    old = [e for e in entries if e.folder in hit]
    rows, made = fresh, []
    if old:
        held = read_entries(spark, silver, SILVER, old)
        rows = fresh.unionByName(held.select(*TURNS.names).join(ids, same, "left_semi"))
        made.append(write_load(held.join(ids, same, "left_anti"), silver, BASE))
    made.append(write_load(enrich(rows, block_turns), silver, BASE))
    made = indexed(spark, silver, made)
    remove(spark, scratch)
    return [e for e in entries if e.folder not in hit] + made, made


def marts(
    fact: DataFrame,
    totals: DataFrame,
    followed: DataFrame,
    board: DataFrame,
    seed: DataFrame,
    bitmaps: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The other six marts, from the fact, the two tables of counts and the leaderboard."""
    return {
        "agg_matchup_matrix": gold.matchup_matrix(totals, bitmaps),
        "agg_cooperation_over_time": gold.coop_over_time(fact),
        "agg_llm_vs_coded": gold.llm_vs_coded(board, seed),
        "agg_persona_fidelity": fidelity.persona_fidelity(followed),
        "agg_persona_fidelity_by_opponent": fidelity.fidelity_by_opponent(followed),
        "agg_reciprocity": gold.reciprocity(totals),
    }


def build_gold(
    spark: SparkSession,
    silver: str,
    root: str,
    seed_path: str | None = None,
    match_counts: str | None = None,
) -> dict[str, DataFrame]:
    """Rebuild staging view, fact, dimension and marts under ``root``; return the tables.

    ``match_counts`` is the path of a match state that ``update_match_state`` has brought up to the
    same log; matches are then counted by its bitmaps. The fact is read three times: for the totals
    per match, for the fidelity counts and for cooperation over time. Everything else reads the
    written counts.
    """
    seed = seed_agents(spark, seed_path)
    bitmaps = match_state(spark, match_counts) if match_counts else None
    turns = as_view(spark, STAGING, "stg_turns", STAGING_COLUMNS, silver)

    def table(df: DataFrame, name: str) -> DataFrame:
        return as_table(df, MARTS, name, root)

    with sized_for(spark, silver):
        fact = table(gold.fct_turns(turns, seed), "fct_turns")
        totals = table(gold.match_totals(fact), "match_totals")
        expected = fidelity.expected_move(fact)
        followed = table(fidelity.fidelity_totals(expected), "fidelity_totals")
        tables = {"fct_turns": fact}
        # The totals list every player of the log.
        tables["dim_agent"] = table(gold.dim_agent(totals, seed), "dim_agent")
        board = table(gold.leaderboard(totals, seed, bitmaps), "agg_agent_leaderboard")
        tables["agg_agent_leaderboard"] = board
        for name, mart in marts(fact, totals, followed, board, seed, bitmaps).items():
            tables[name] = table(mart, name)
    return tables


def run_tests(silver: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The 13 data tests over built tables: one row each, with the number of failures."""
    return quality.all_tests(
        tables["fct_turns"], tables["dim_agent"], tables["agg_persona_fidelity"], silver
    )
