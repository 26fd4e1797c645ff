"""How closely a persona follows its rule, by replaying the rule on the recorded history."""

from __future__ import annotations

from pyspark.sql import DataFrame

from turnlake.functions.turns import named, ratio
from turnlake.operators.history import BLOCK_TURNS, HISTORY_COLUMNS, with_history


def grim_state(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Add ``opp_defected_before``: 1 from the turn after the opponent's first defection.

    Also adds ``opponent_last_move`` to rows that lack it, so bronze rows serve as well as
    rows of the fact, whose own values stay.
    """
    held = {c: f"_held_{c}" for c in HISTORY_COLUMNS if c in turns.columns}
    state = with_history(turns.withColumnsRenamed(held), block_turns)
    added = [] if "opponent_last_move" in held else ["opponent_last_move"]
    return state.selectExpr(
        *[f"{held.get(c, c)} AS {c}" for c in turns.columns],
        *added,
        "int(opp_defections_before > 0) AS opp_defected_before",
    )


# What makes each rule defect. A rule cooperates wherever that is false, and its
# move is not determined (NULL) where the history leaves it open.
DEFECTS_IF = {
    "always_cooperate": "false",
    "always_defect": "true",
    "grim_trigger": "opp_defected_before = 1",
    "tit_for_tat": "turn > 1 AND opponent_last_move = 'D'",
}
_DEFECTS = " ".join(f"WHEN '{rule}' THEN {reason}" for rule, reason in DEFECTS_IF.items())
RULE_MOVE = (
    f"CASE (CASE player_coded_equivalent {_DEFECTS} END) WHEN true THEN 'D' WHEN false THEN 'C' END"
)


def expected_move(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The model-played turns with the rule's move beside the one played.

    ``turns`` is the fact, or bronze rows with the players' equivalents. A player's type is
    the same for a whole perspective, so the filter may stand below the window, where
    Catalyst would not move it.
    """
    personas = turns.where("player_type = 'llm'")
    return grim_state(personas, block_turns).selectExpr("*", RULE_MOVE + " AS expected_move")


def fidelity_totals(expected: DataFrame) -> DataFrame:
    """Counts per persona and opponent, the finest grain that both fidelity marts need."""
    measures = {
        "n": "count(*)",
        "n_expected": "count(expected_move)",
        "n_followed": "count_if(move = expected_move)",
        "n_must_d": "count_if(expected_move = 'D')",
        "n_did_d": "count_if(expected_move = 'D' AND move = 'D')",
        "n_must_c": "count_if(expected_move = 'C')",
        "n_did_c": "count_if(expected_move = 'C' AND move = 'C')",
        "n_parsable": "count_if(is_parsable)",
        "n_answers": "count(is_parsable)",
    }
    keys = ["player", "player_coded_equivalent", "player_equivalence", "opponent"]
    return expected.groupBy(*keys).agg(*named(measures))


def persona_fidelity(totals: DataFrame) -> DataFrame:
    """Share of evaluable turns that follow the rule, overall and by what the rule demands."""
    measures = {
        "n_tours": "sum(n)",
        "n_tours_evaluables": "sum(n_expected)",
        "fidelite": ratio("sum(n_followed)", "sum(n_expected)"),
        "riposte_attendue_respectee": ratio("sum(n_did_d)", "sum(n_must_d)"),
        "cooperation_attendue_respectee": ratio("sum(n_did_c)", "sum(n_must_c)"),
        "taux_parsable": ratio("sum(n_parsable)", "sum(n_answers)"),
    }
    keys = ["player", "player_coded_equivalent", "player_equivalence"]
    return totals.groupBy(*keys).agg(*named(measures)).selectExpr(
        "player AS persona",
        "player_coded_equivalent AS coded_equivalent",
        "player_equivalence AS equivalence",
        *measures,
    )


def fidelity_by_opponent(totals: DataFrame) -> DataFrame:
    measures = {
        "n_tours": "sum(n)",
        "fidelite": ratio("sum(n_followed)", "sum(n_expected)"),
    }
    sums = totals.groupBy("player", "opponent").agg(*named(measures))
    return sums.withColumnRenamed("player", "persona")
