"""What each player could know before a turn: the ordered state of one perspective."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import expr

from turnlake.schemas import PERSPECTIVE

# Turns of one match and seat that one task orders together.
BLOCK_TURNS = 100_000

# Running totals by name, as aggregates over turns.
_TOTALS = {
    "own_score": "sum(payoff)",
    "opp_score": "sum(opponent_payoff)",
    "own_coops": "count_if(move <=> 'C')",
    "opp_coops": "count_if(opponent_move <=> 'C')",
    "opp_defections": "count_if(opponent_move <=> 'D')",
}

HISTORY_COLUMNS = [
    "turns_before",
    *[f"{name}_before" for name in _TOTALS],
    "opponent_last_move",
    "opponent_defection_streak",
]

_AT = [*PERSPECTIVE, "_block"]
_BLOCK = "PARTITION BY match_id, seat, _block ORDER BY turn"
_MATCH = "PARTITION BY match_id, seat ORDER BY _block"
_EARLIER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
# Row of the block at which a run of defections by the opponent ends.
_BREAK = "max(CASE WHEN NOT opponent_move <=> 'D' THEN _row END)"


def with_history(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Add ``HISTORY_COLUMNS``, all over strictly earlier turns of the same match and seat.

    One shuffle and one sort on (match, seat, block of turns) serve every column. A match of
    up to ``block_turns`` turns is one block. The later blocks of a longer match start from
    the state its earlier blocks end in; those states come from a second pass over such
    matches alone. The result does not depend on ``n_turns``, see ``_long_matches``.
    """
    rows = _numbered(turns, block_turns).selectExpr(
        "*",
        *[f"{total} OVER ({_BLOCK} {_EARLIER}) AS _{n}" for n, total in _TOTALS.items()],
        f"lag(opponent_move) OVER ({_BLOCK}) AS _last",
        f"{_BREAK} OVER ({_BLOCK} {_EARLIER}) AS _break",
    )
    joined = rows.join(_block_starts(turns, block_turns), _AT, "left")
    before = "coalesce(_start_rows, 0) + _row - 1"
    last_break = "coalesce(coalesce(_start_rows, 0) + _break, _start_break, 0)"
    return joined.selectExpr(
        *turns.columns,
        f"{before} AS turns_before",
        *[f"coalesce(_start_{n}, 0) + coalesce(_{n}, 0) AS {n}_before" for n in _TOTALS],
        "CASE WHEN _row = 1 THEN _start_last ELSE _last END AS opponent_last_move",
        f"CAST({before} - {last_break} AS INT) AS opponent_defection_streak",
    )


def _numbered(turns: DataFrame, block_turns: int) -> DataFrame:
    """Add each turn's block and its row number there."""
    return turns.selectExpr("*", f"(turn - 1) div {block_turns} AS _block").selectExpr(
        "*", f"row_number() OVER ({_BLOCK}) AS _row"
    )


def _long_matches(turns: DataFrame, block_turns: int) -> DataFrame:
    """The turns of matches that go beyond one block.

    Rows that declare such a length are found by a filter that reaches the scan. The rows of one
    match may disagree, or all declare fewer turns than there are, so the other rows of the first
    blocks are taken by the ids of matches with later turns; only if the log holds any, which one
    number looked up at run time says, are those rows read.
    """
    declared = f"n_turns > {block_turns} OR n_turns IS NULL OR turn > {block_turns}"
    later = turns.where(f"turn > {block_turns}")
    found = later.agg(F.count("*")).scalar() > 0
    rest = turns.where(f"NOT ({declared})").where(found)
    ids = later.select("match_id").distinct()
    return turns.where(declared).unionByName(rest.join(ids, "match_id", "left_semi"))


def _block_starts(turns: DataFrame, block_turns: int) -> DataFrame:
    """State at the start of each block but the first, one row per (match, seat, block)."""
    blocks = (
        _numbered(_long_matches(turns, block_turns), block_turns)
        .groupBy(*_AT)
        .agg(
            *map(
                expr,
                [
                    "count(*) AS _rows",
                    f"{_BREAK} AS _break",
                    "max_by(opponent_move, turn) AS _last",
                    *[f"{total} AS _{n}" for n, total in _TOTALS.items()],
                ],
            )
        )
        .selectExpr("*", f"sum(_rows) OVER ({_MATCH} {_EARLIER}) AS _start_rows")
    )
    last_break = "max(coalesce(_start_rows, 0) + _break)"
    return blocks.selectExpr(
        *_AT,
        "_start_rows",
        f"{last_break} OVER ({_MATCH} {_EARLIER}) AS _start_break",
        f"lag(_last) OVER ({_MATCH}) AS _start_last",
        *[f"sum(_{n}) OVER ({_MATCH} {_EARLIER}) AS _start_{n}" for n in _TOTALS],
    ).where("_start_rows IS NOT NULL")
