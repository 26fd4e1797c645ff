"""Paired decisions to one row per turn and seat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.functions.turns import named
from turnlake.schemas import PAYOFFS, TURNS, payoff_table


def tidy_seats(paired: DataFrame) -> DataFrame:
    """Turn each paired decision (columns ``a_*`` and ``b_*``) into one row per seat.

    The seats of a turn sit in one row, so this is a narrow operation.
    """
    shared = ["match_id", "repeat", "turn", "n_turns", "run_id", "played_at"]

    def side(seat: str, own: str, other: str) -> str:
        columns = {
            "seat": f"'{seat}'",
            "player": f"{own}_player",
            "player_type": f"{own}_type",
            "opponent": f"{other}_player",
            "opponent_type": f"{other}_type",
            "move": f"{own}_move",
            "opponent_move": f"{other}_move",
            "response_time": f"{own}_response_time",
            "raw_output": f"{own}_raw_output",
            "is_parsable": f"{own}_is_parsable",
        }
        return "struct(" + ", ".join(f"{c} AS {n}" for n, c in columns.items()) + ")"

    sides = f"explode(array({side('A', 'a', 'b')}, {side('B', 'b', 'a')})) AS side"
    return paired.selectExpr(*shared, sides).select(*shared, "side.*")


def payoff_join(seats: DataFrame) -> DataFrame:
    """Add both players' gains; the payoff table has four rows and is broadcast.

    Turns with a move that the table lacks stay, without gains; the accepted-values test
    counts them.
    """
    payoffs = F.broadcast(payoff_table(seats.sparkSession))
    return seats.join(payoffs, ["move", "opponent_move"], "left")


def build_bronze(paired: DataFrame) -> DataFrame:
    bronze = payoff_join(tidy_seats(paired))
    return bronze.selectExpr(
        *[f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in TURNS.fields]
    )


def observed_payoffs(turns: DataFrame) -> DataFrame:
    """Each (move, opponent move) of the log with the least and greatest gain recorded."""
    measures = {"n": "count(*)", "lowest": "min(payoff)", "highest": "max(payoff)"}
    return turns.groupBy("move", "opponent_move").agg(*named(measures))


def payoff_matrix_check(turns: DataFrame) -> DataFrame:
    """Whether the gains in the log form a true dilemma: T > R > P > S and 2R > T + S.

    ``is_consistent`` says that every pair of moves always pays the same, and
    ``matches_declared`` that it pays what the payoff table says.
    """

    def gain(moves: str) -> str:
        return f"max(CASE WHEN move || opponent_move = '{moves}' THEN highest END)"

    declared = " OR ".join(
        f"(move = '{move}' AND opponent_move = '{other}' AND highest = {own})"
        for move, other, own, _ in PAYOFFS
    )
    matrix = {
        "temptation": gain("DC"),
        "reward": gain("CC"),
        "punishment": gain("DD"),
        "sucker": gain("CD"),
        "is_consistent": "bool_and(lowest = highest)",
        "matches_declared": f"bool_and(lowest = highest AND ({declared}))",
    }
    return observed_payoffs(turns).agg(*named(matrix)).selectExpr(
        "*",
        "temptation > reward AND reward > punishment AND punishment > sucker AS is_ordered",
        "2 * reward > temptation + sucker AS beats_alternation",
    )
