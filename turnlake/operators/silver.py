"""Bronze to silver: nine derived columns per turn and seat."""

from __future__ import annotations

from pyspark.sql import DataFrame

from turnlake.functions.summary import summary_text
from turnlake.functions.turns import OUTCOME
from turnlake.operators.history import BLOCK_TURNS, with_history
from turnlake.schemas import STAGING_COLUMNS, TURNS


def enrich(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Scores and cooperation rates include the current turn, the rest looks strictly back.

    Rates divide by the turn's number, also where the log lacks earlier turns.
    """

    def rate(before: str, move: str) -> str:
        return f"CAST({before} + int({move} <=> 'C') AS DOUBLE) / turn"

    derived = {
        "own_cum_score": "own_score_before + payoff",
        "opp_cum_score": "opp_score_before + opponent_payoff",
        "own_coop_rate": rate("own_coops_before", "move"),
        "opp_coop_rate": rate("opp_coops_before", "opponent_move"),
        "opponent_last_move": "opponent_last_move",
        "opponent_defection_streak": "opponent_defection_streak",
        "forgave_this_turn": "move <=> 'C' AND opponent_last_move <=> 'D'",
        "retaliated_this_turn": "move <=> 'D' AND opponent_last_move <=> 'D'",
        "round_outcome": OUTCOME,
    }
    columns = [f"{text} AS {name}" for name, text in derived.items()]
    return with_history(turns, block_turns).selectExpr(*TURNS.names, *columns)


def staged(silver: DataFrame) -> DataFrame:
    """The staging projection: the 27 columns by name, in staging order."""
    return silver.select(*STAGING_COLUMNS)


def history_summaries(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """For each decision, the text that sums up the match before it."""
    return with_history(turns, block_turns).select(
        "match_id", "seat", "turn", "player", summary_text().alias("memory_summary")
    )
