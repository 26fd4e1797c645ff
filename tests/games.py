"""Small turn logs for tests."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

from turnlake.schemas import PAYOFFS, TURNS

GAIN = {(own, other): gain for own, other, gain, _ in PAYOFFS}


def seat_rows(
    match_id: str,
    a_moves: str,
    b_moves: str,
    a: str = "tit_for_tat",
    b: str = "grim_trigger",
    a_type: str = "coded",
    b_type: str = "coded",
    repeat: int = 1,
    turns: list[int] | None = None,
    **extra,
) -> list[dict]:
    turns = turns or list(range(1, len(a_moves) + 1))
    rows = []
    for turn, x, y in zip(turns, a_moves, b_moves):
        for seat, own, other, me, it, mine, its in (
            ("A", x, y, a, b, a_type, b_type),
            ("B", y, x, b, a, b_type, a_type),
        ):
            rows.append(
                {
                    "match_id": match_id,
                    "seat": seat,
                    "repeat": repeat,
                    "turn": turn,
                    "n_turns": max(turns),
                    "player": me,
                    "player_type": mine,
                    "opponent": it,
                    "opponent_type": its,
                    "move": own,
                    "opponent_move": other,
                    "payoff": GAIN[own, other],
                    "opponent_payoff": GAIN[other, own],
                    "response_time": None,
                    "raw_output": None,
                    "is_parsable": True,
                    "run_id": "test",
                    "played_at": "2024-01-01T00:00:00+00:00",
                    **extra,
                }
            )
    return rows


def log(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[c] for c in TURNS.names) for r in rows], TURNS)


def random_rows(seed: int, n_matches: int = 12, gaps: bool = False) -> list[dict]:
    rng = random.Random(seed)
    rows = []
    for i in range(n_matches):
        length = rng.randint(1, 23)
        turns = sorted(rng.sample(range(1, 2 * length + 1), length)) if gaps else None
        bias = rng.random()
        a, b = (
            "".join("C" if rng.random() < bias else "D" for _ in range(length))
            for _ in range(2)
        )
        rows += seat_rows(f"m{i}", a, b, turns=turns)
    rng.shuffle(rows)
    return rows


def by_key(df: DataFrame) -> dict[tuple, dict]:
    return {(r["match_id"], r["seat"], r["turn"]): r.asDict() for r in df.collect()}
