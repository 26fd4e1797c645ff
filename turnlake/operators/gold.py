"""Dimension, fact and the marts that come from per-match totals.

Most marts need only sums and counts per match and seat. ``match_totals`` reads the fact
once and keeps those as integers, so each mart below is a small second aggregation and its
rates are exact quotients of counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.functions.turns import OUTCOME, named, phi, ratio, surrogate_key
from turnlake.operators.match_counts import distinct_matches
from turnlake.schemas import OUTCOMES, TURN_KEY


def dim_agent(turns: DataFrame, seed: DataFrame) -> DataFrame:
    """Every player of the log, with the seed's attributes where the seed has them."""
    used = turns.selectExpr("player AS agent_name").distinct()
    return used.join(seed, "agent_name", "left").select(*seed.columns)


def with_equivalents(turns: DataFrame, seed: DataFrame) -> DataFrame:
    """Add the player's rule equivalent.

    Spark broadcasts the seed by its size in bytes, and splits hot players where it does not.
    Joining the seed gives the same rows as joining the dimension, which adds only players
    without attributes, and needs no pass over the log to list the players.
    """
    attributes = seed.selectExpr(
        "agent_name AS player",
        "coded_equivalent AS player_coded_equivalent",
        "equivalence AS player_equivalence",
    )
    joined = turns.join(attributes, "player", "left")
    return joined.select(*turns.columns, *attributes.columns[1:])


def fct_turns(silver: DataFrame, seed: DataFrame) -> DataFrame:
    """One row per (match, turn, seat) with its key and the player's rule equivalent."""
    key = surrogate_key(*TURN_KEY) + " AS turn_key"
    return with_equivalents(silver.selectExpr(key, *silver.columns), seed)


_MATCH = ["match_id", "seat", "repeat", "player", "player_type", "opponent"]


def match_totals(turns: DataFrame) -> DataFrame:
    """Sums and counts per match and seat.

    Bronze rows give the columns that need no history; silver and fact rows give all.
    """
    measures = {
        "n": "count(*)",
        "last_turn": "max(turn)",
        "payoff": "sum(payoff)",
        "n_payoff": "count(payoff)",
        "n_coop": "count_if(move = 'C')",
        "response_time": "sum(response_time)",
        "n_response_time": "count(response_time)",
        "n_parsable": "count_if(is_parsable)",
        "n_answers": "count(is_parsable)",
        **{f"n_{name}": f"count_if({OUTCOME} = '{name}')" for name in OUTCOMES},
    }
    if "opponent_last_move" in turns.columns:
        known = "opponent_last_move IS NOT NULL"
        measures |= {
            "n_betrayed": "count_if(opponent_last_move = 'D')",
            "n_forgave": "count_if(opponent_last_move = 'D' AND forgave_this_turn)",
            "n_retaliated": "count_if(opponent_last_move = 'D' AND retaliated_this_turn)",
            "n_known": "count(opponent_last_move)",
            "n_known_coop": f"count_if({known} AND move = 'C')",
            "n_known_last_c": "count_if(opponent_last_move = 'C')",
            "n_known_both_c": "count_if(opponent_last_move = 'C' AND move = 'C')",
            "known_payoff": f"sum(CASE WHEN {known} THEN payoff END)",
            "n_known_payoff": f"count(CASE WHEN {known} THEN payoff END)",
        }
    return turns.groupBy(*_MATCH).agg(*named(measures))


MEAN_PAYOFF = ratio("sum(payoff)", "sum(n_payoff)")
COOP_RATE = ratio("sum(n_coop)", "sum(n)")


def _with_matches(
    totals: DataFrame, keys: list[str], measures: dict[str, str], bitmaps: DataFrame | None
) -> DataFrame:
    """Measures per key; matches come from kept bitmaps, or by comparing the ids of the totals."""
    if bitmaps is None:
        return totals.groupBy(*keys).agg(*named(measures))
    rest = {name: text for name, text in measures.items() if name != "n_matches"}
    rows = totals.groupBy(*keys).agg(*named(rest)).alias("rows")
    counts = distinct_matches(bitmaps, keys).alias("counts")
    same = " AND ".join(f"rows.{k} <=> counts.{k}" for k in keys)
    n = F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches")
    joined = rows.join(counts, F.expr(same), "left").select("rows.*", n)
    return joined.select(*keys, *measures)


def leaderboard(
    totals: DataFrame, seed: DataFrame, bitmaps: DataFrame | None = None
) -> DataFrame:
    """Score, cooperation, forgiveness and retaliation per agent.

    The type is the seed's, NULL for agents outside it. Aggregating by player first leaves
    one row per agent for the join. A self-play match counts once as a match, and both its
    seats count as turns. With ``bitmaps`` of the same log (``sources.match_state``) matches are
    counted by those, and no match ids are shuffled.
    """
    measures = {
        "n_turns_joues": "sum(n)",
        "n_matches": "count(DISTINCT match_id)",
        "score_moyen_par_tour": MEAN_PAYOFF,
        "score_total": "sum(payoff)",
        "taux_cooperation": COOP_RATE,
        "taux_pardon": ratio("sum(n_forgave)", "sum(n_betrayed)"),
        "taux_riposte": ratio("sum(n_retaliated)", "sum(n_betrayed)"),
        "temps_moyen_reponse_s": ratio("sum(response_time)", "sum(n_response_time)"),
    }
    per_agent = _with_matches(totals, ["player"], measures, bitmaps)
    types = seed.selectExpr("agent_name AS player", "agent_type")
    return per_agent.join(types, "player", "left").selectExpr(
        "player AS agent", "agent_type", *measures
    )


def matchup_matrix(totals: DataFrame, bitmaps: DataFrame | None = None) -> DataFrame:
    """Matches, score and cooperation per ordered pair; ``bitmaps`` as for the leaderboard."""
    measures = {
        "n_matches": "count(DISTINCT match_id)",
        "score_moyen_par_tour": MEAN_PAYOFF,
        "taux_cooperation": COOP_RATE,
    }
    return _with_matches(totals, ["player", "opponent"], measures, bitmaps)


def coop_over_time(turns: DataFrame) -> DataFrame:
    """Cooperation and score per agent and turn number; the type is the log's own."""
    measures = {
        "taux_cooperation": ratio("count_if(move = 'C')", "count(*)"),
        "score_moyen": ratio("sum(payoff)", "count(payoff)"),
    }
    return (
        turns.groupBy("player", "player_type", "turn")
        .agg(*named(measures))
        .selectExpr("player AS agent", "player_type AS agent_type", "turn", *measures)
    )


def reciprocity(totals: DataFrame) -> DataFrame:
    """Correlation of a player's move with the opponent's previous move.

    First turns do not count. NULL for agents whose moves, or whose opponents', never vary.
    """
    counts = {
        "n": "sum(n_known)",
        "own_c": "sum(n_known_coop)",
        "last_c": "sum(n_known_last_c)",
        "both_c": "sum(n_known_both_c)",
        "score": ratio("sum(known_payoff)", "sum(n_known_payoff)"),
    }
    return (
        totals.where("n_known > 0")
        .groupBy("player", "player_type")
        .agg(*named(counts))
        .selectExpr(
            "player AS agent",
            "player_type AS agent_type",
            "n AS n_tours",
            phi("n", "both_c", "own_c", "last_c") + " AS reciprocite",
            "score AS score_moyen_par_tour",
            ratio("own_c", "n") + " AS taux_cooperation",
        )
    )


def llm_vs_coded(board: DataFrame, seed: DataFrame) -> DataFrame:
    """Each persona beside the agent that is its rule equivalent, if that agent played.

    An equivalent may be any agent of the leaderboard. Every agent stands for itself as a
    rule, and a persona also under its equivalent; the two meet per rule. That reads the
    leaderboard once, where a join of it with itself would compute it twice.
    """
    measures = {
        "score_moyen": "score_moyen_par_tour",
        "coop": "taux_cooperation",
        "pardon": "taux_pardon",
        "riposte": "taux_riposte",
    }
    personas = seed.where("agent_type = 'llm'").selectExpr(
        "agent_name AS agent", "coded_equivalent", "true AS is_persona"
    )
    roles = """explode(filter(array(
        if(agent IS NOT NULL, struct(false AS as_persona, agent AS rule), NULL),
        if(is_persona, struct(true AS as_persona, coded_equivalent AS rule), NULL)),
        r -> r IS NOT NULL)) AS role"""
    code = "max(CASE WHEN NOT role.as_persona THEN {} END) OVER (PARTITION BY role.rule)"
    columns = {}
    for name, column in measures.items():
        columns[f"{name}_persona"] = column
        columns[f"{name}_code"] = code.format(column)
    return (
        board.join(personas, "agent", "left")
        .selectExpr("*", roles)
        .selectExpr(
            "role.as_persona",
            "agent AS persona",
            "coded_equivalent",
            *[f"{text} AS {name}" for name, text in columns.items()],
            "temps_moyen_reponse_s",
        )
        .where("as_persona")
        .drop("as_persona")
    )


def outcome_counts(totals: DataFrame) -> DataFrame:
    """Turns per outcome, without the outcomes that never occur."""
    sums = totals.agg(*named({name: f"coalesce(sum(n_{name}), 0)" for name in OUTCOMES}))
    return sums.unpivot([], OUTCOMES, "round_outcome", "n").where("n > 0")


def silver_stats(totals: DataFrame) -> DataFrame:
    return totals.agg(
        *named({"n_rows": "coalesce(sum(n), 0)", "n_matches": "count(DISTINCT match_id)"})
    )
