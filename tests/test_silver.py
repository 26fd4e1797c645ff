from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from games import by_key, log, random_rows, seat_rows
from turnlake.operators.history import with_history
from turnlake.operators.silver import enrich, history_summaries, staged
from turnlake.schemas import SILVER, STAGING_COLUMNS

# match G1, seat A plays CDCDCC, seat B plays DCDDCD:
# own score, opponent score, own coops, opponent coops, last move, streak, forgave,
# retaliated, outcome
GOLDEN = {
    "A": [
        (0, 5, 1, 0, None, 0, False, False, "exploited"),
        (5, 5, 1, 1, "D", 1, False, True, "exploiter"),
        (5, 10, 2, 1, "C", 0, False, False, "exploited"),
        (6, 11, 2, 1, "D", 1, False, True, "mutual_defect"),
        (9, 14, 3, 2, "D", 2, True, False, "mutual_coop"),
        (9, 19, 4, 2, "C", 0, False, False, "exploited"),
    ],
    "B": [
        (5, 0, 0, 1, None, 0, False, False, "exploiter"),
        (5, 5, 1, 1, "C", 0, False, False, "exploited"),
        (10, 5, 1, 2, "D", 1, False, True, "exploiter"),
        (11, 6, 1, 2, "C", 0, False, False, "mutual_defect"),
        (14, 9, 2, 3, "D", 1, True, False, "mutual_coop"),
        (19, 9, 2, 4, "C", 0, False, False, "exploiter"),
    ],
}


@pytest.mark.parametrize("block_turns", [100_000, 2, 1])
def test_golden_match(spark, block_turns):
    got = by_key(enrich(log(spark, seat_rows("G1", "CDCDCC", "DCDDCD")), block_turns))
    for seat, expected in GOLDEN.items():
        for turn, (own, opp, mine, its, last, streak, forgave, hit, outcome) in enumerate(
            expected, 1
        ):
            row = got["G1", seat, turn]
            assert (row["own_cum_score"], row["opp_cum_score"]) == (own, opp)
            assert (row["own_coop_rate"], row["opp_coop_rate"]) == (mine / turn, its / turn)
            assert row["opponent_last_move"] == last
            assert row["opponent_defection_streak"] == streak
            assert (row["forgave_this_turn"], row["retaliated_this_turn"]) == (forgave, hit)
            assert row["round_outcome"] == outcome


def brute_force(rows: list[dict]) -> dict[tuple, dict]:
    """Each turn's columns from the list of all turns up to it."""
    out = {}
    for row in rows:
        past = sorted(
            (
                r
                for r in rows
                if (r["match_id"], r["seat"]) == (row["match_id"], row["seat"])
                and r["turn"] < row["turn"]
            ),
            key=lambda r: r["turn"],
        )
        seen = [*past, row]
        theirs = "".join(r["opponent_move"] for r in past)
        last = theirs[-1:] or None
        out[row["match_id"], row["seat"], row["turn"]] = {
            **row,
            "own_cum_score": sum(r["payoff"] for r in seen),
            "opp_cum_score": sum(r["opponent_payoff"] for r in seen),
            "own_coop_rate": [r["move"] for r in seen].count("C") / row["turn"],
            "opp_coop_rate": [r["opponent_move"] for r in seen].count("C") / row["turn"],
            "opponent_last_move": last,
            "opponent_defection_streak": len(theirs) - len(theirs.rstrip("D")),
            "forgave_this_turn": row["move"] == "C" and last == "D",
            "retaliated_this_turn": row["move"] == "D" and last == "D",
            "round_outcome": {
                "CC": "mutual_coop",
                "DD": "mutual_defect",
                "CD": "exploited",
                "DC": "exploiter",
            }[row["move"] + row["opponent_move"]],
        }
    return out


@pytest.mark.parametrize("gaps", [False, True])
@pytest.mark.parametrize("block_turns", [100_000, 7, 3, 1])
def test_random_logs_match_brute_force(spark, block_turns, gaps):
    rows = random_rows(block_turns, gaps=gaps)
    assert by_key(enrich(log(spark, rows), block_turns)) == brute_force(rows)


def test_missing_n_turns_still_gives_block_starts(spark):
    rows = [{**r, "n_turns": None} for r in random_rows(5)]
    assert by_key(enrich(log(spark, rows), 4)) == brute_force(rows)


@pytest.mark.parametrize("declared", [None, 0, 2, 3, 5, 900])
def test_same_rows_whatever_n_turns_says(spark, declared):
    rows = [{**r, "n_turns": declared} for r in seat_rows("m", "CDCCDCC", "DDDCDDD")]
    rows += seat_rows("short", "CD", "DD")
    for block_turns in (2, 3, 100):
        assert by_key(enrich(log(spark, rows), block_turns)) == brute_force(rows)


@pytest.mark.parametrize("early, late", [(1, 7), (1, None), (7, 1), (None, 1), (2, 3)])
def test_same_rows_where_turns_of_a_match_declare_different_lengths(spark, early, late):
    rows = seat_rows("m", "CDCCDCC", "DDDCDDD") + seat_rows("short", "CD", "DD")
    for block_turns in (2, 3):
        own = [{**r, "n_turns": early if r["turn"] <= block_turns else late} for r in rows]
        assert by_key(enrich(log(spark, own), block_turns)) == brute_force(own)


def test_schema_and_staging_order(spark, bronze):
    silver = enrich(bronze)
    assert [(f.name, f.dataType) for f in silver.schema] == [
        (f.name, f.dataType) for f in SILVER
    ]
    assert staged(silver).columns == STAGING_COLUMNS
    assert len(STAGING_COLUMNS) == len(set(STAGING_COLUMNS)) == 27


def test_seats_mirror_each_other(bronze):
    silver = enrich(bronze)
    a, b = (silver.where(f"seat = '{s}'").alias(s) for s in "AB")
    both = a.join(b, (F.col("A.match_id") == F.col("B.match_id")) & (F.col("A.turn") == F.col("B.turn")))
    assert both.count() == silver.count() // 2
    assert both.where(
        "A.own_cum_score <> B.opp_cum_score OR A.own_coop_rate <> B.opp_coop_rate"
        " OR A.payoff + B.payoff NOT IN (2, 5, 6)"
    ).isEmpty()
    counts = {r[0]: r[1] for r in silver.groupBy("round_outcome").count().collect()}
    assert counts["mutual_coop"] % 2 == counts["mutual_defect"] % 2 == 0
    assert counts["exploited"] == counts["exploiter"]


def test_summary_text(spark):
    rows = seat_rows("m", "CCCCCCCCC", "DCCCCCCDD")
    texts = by_key(history_summaries(log(spark, rows)))

    def text(turn: int, seat: str = "A") -> str:
        return texts["m", seat, turn]["memory_summary"]

    assert text(1) == "Tour 1 — première interaction, aucun historique disponible."
    assert text(2) == (
        "Tour 2 — 1 tour(s) joué(s). L'adversaire a coopéré 0/1 fois (0%). "
        "Toi-même as coopéré 1/1 fois (100%). Au dernier tour, l'adversaire t'a trahi. "
        "Trahisons consécutives actuelles de l'adversaire : 1. "
        "Score cumulé — toi : 0, adversaire : 5."
    )
    assert text(3) == (
        "Tour 3 — 2 tour(s) joué(s). L'adversaire a coopéré 1/2 fois (50%). "
        "Toi-même as coopéré 2/2 fois (100%). Au dernier tour, l'adversaire a coopéré. "
        "Score cumulé — toi : 3, adversaire : 8."
    )
    # 7/8 and 6/8; then 6/9 after two defections in a row.
    assert "6/8 fois (75%)" in text(9)
    # 1/8 is 12.5 %, which goes to the even 12.
    eighth = by_key(history_summaries(log(spark, seat_rows("e", "C" * 9, "CDDDDDDDD"))))
    assert "a coopéré 1/8 fois (12%)" in eighth["e", "A", 9]["memory_summary"]
    assert "Trahisons consécutives actuelles de l'adversaire : 7." in (
        eighth["e", "A", 9]["memory_summary"]
    )


def test_percent_text_matches_python(spark):
    from turnlake.functions.summary import percent

    pairs = [(p, n) for n in range(1, 201) for p in range(n + 1)]
    df = spark.createDataFrame(pairs, "p long, n long")
    got = df.select("p", "n", percent(F.col("p"), F.col("n")).alias("t")).collect()
    assert all(f"{r.p / r.n:.0%}" == f"{r.t}%" for r in got)


def test_history_survives_many_blocks_of_one_hot_match(spark):
    """One match with most rows, in blocks far smaller than the match."""
    rows = seat_rows("hot", "CD" * 200, "DDC" * 133 + "D") + random_rows(3)
    whole, split = (
        {k: v for k, v in by_key(with_history(log(spark, rows), n)).items()}
        for n in (100_000, 16)
    )
    assert whole == split
