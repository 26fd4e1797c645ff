from __future__ import annotations

import math

import pytest

from games import log, random_rows, seat_rows
from turnlake.operators import fidelity, gold, quality
from turnlake.operators.silver import enrich, staged


def rows_by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def fact_of(spark, seed, rows):
    return gold.fct_turns(staged(enrich(log(spark, rows))), seed)


def replayed(spark, seed, rows):
    expected = fidelity.expected_move(fact_of(spark, seed, rows))
    return expected, fidelity.fidelity_totals(expected)


G1 = ("CDCDCC", "DCDDCD")


def test_golden_leaderboard_and_reciprocity(spark, seed):
    totals = gold.match_totals(
        fact_of(spark, seed, seat_rows("G1", *G1, a="tit_for_tat", b="random"))
    )
    board = rows_by(gold.leaderboard(totals, seed), "agent")
    a, b = board["tit_for_tat"], board["random"]
    assert (a.score_moyen_par_tour, a.taux_cooperation) == (9 / 6, 4 / 6)
    assert (a.taux_pardon, a.taux_riposte) == (1 / 3, 2 / 3)
    assert (b.score_moyen_par_tour, b.taux_cooperation) == (19 / 6, 2 / 6)
    assert (b.taux_pardon, b.taux_riposte) == (1 / 2, 1 / 2)
    recip = rows_by(gold.reciprocity(totals), "agent")
    assert recip["tit_for_tat"].n_tours == 5
    assert math.isclose(recip["tit_for_tat"].reciprocite, 2 / 3, rel_tol=1e-15)


@pytest.mark.parametrize(
    "persona, moves, overall, must_d, must_c",
    [
        ("persona_calculateur", "CDCDDC", 5 / 6, 2 / 3, 3 / 3),
        ("persona_rancunier", "CDDDDD", 3 / 6, 2 / 5, 1 / 1),
    ],
)
def test_golden_fidelity(spark, seed, persona, moves, overall, must_d, must_c):
    rows = seat_rows("G1", *G1, a=persona, a_type="llm", b="random")
    expected, totals = replayed(spark, seed, rows)
    played = [r.expected_move for r in expected.orderBy("turn").collect()]
    assert "".join(played) == moves
    mart = rows_by(fidelity.persona_fidelity(totals), "persona")[persona]
    assert mart.n_tours == mart.n_tours_evaluables == 6
    assert mart.fidelite == overall
    assert mart.riposte_attendue_respectee == must_d
    assert mart.cooperation_attendue_respectee == must_c
    assert mart.taux_parsable == 1.0


def test_replay_from_bronze_equals_replay_from_fact(spark, seed, bronze):
    fact = gold.fct_turns(staged(enrich(bronze)), seed)
    columns = ["match_id", "seat", "turn", "move", "expected_move"]
    a = fidelity.expected_move(fact).select(*columns)
    b = fidelity.expected_move(gold.with_equivalents(bronze, seed)).select(*columns)
    split = fidelity.expected_move(fact, block_turns=4).select(*columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert a.exceptAll(split).isEmpty() and split.exceptAll(a).isEmpty()


def test_agents_outside_the_seed(spark, seed):
    rows = seat_rows("m", "CDC", "DDC", a="newcomer", b="persona_empathique", b_type="llm")
    turns = log(spark, rows)
    dim = rows_by(gold.dim_agent(turns, seed), "agent_name")
    assert set(dim) == {"newcomer", "persona_empathique"}
    assert dim["newcomer"].agent_type is None
    board = rows_by(gold.leaderboard(gold.match_totals(enrich(turns)), seed), "agent")
    assert board["newcomer"].agent_type is None
    over_time = gold.coop_over_time(turns).where("agent = 'newcomer'").collect()
    assert {r.agent_type for r in over_time} == {"coded"}


def test_equivalents_without_a_determined_move(spark):
    from turnlake.schemas import SEED

    seed = spark.createDataFrame(
        [("p_random", "llm", "", "random", "stricte"), ("p_free", "llm", "", None, None)], SEED
    )
    rows = seat_rows("m", *G1, a="p_random", b="p_free", a_type="llm", b_type="llm")
    expected, totals = replayed(spark, seed, rows)
    assert {r.expected_move for r in expected.collect()} == {None}
    mart = rows_by(fidelity.persona_fidelity(totals), "persona")
    assert mart["p_random"].fidelite is None and mart["p_random"].n_tours_evaluables == 0
    board = gold.leaderboard(gold.match_totals(enrich(log(spark, rows))), seed)
    versus = rows_by(gold.llm_vs_coded(board, seed), "persona")
    assert versus["p_free"].coded_equivalent is None
    assert versus["p_random"].score_moyen_code is None


def test_single_turn_and_undefeated_agents(spark, seed):
    rows = seat_rows("one", "C", "D") + seat_rows(
        "nice", "CCC", "CCC", a="always_cooperate", b="persona_rancunier", b_type="llm"
    )
    totals = gold.match_totals(enrich(log(spark, rows)))
    assert set(rows_by(gold.reciprocity(totals), "agent")) == {
        "always_cooperate",
        "persona_rancunier",
    }
    assert all(r.reciprocite is None for r in gold.reciprocity(totals).collect())
    board = rows_by(gold.leaderboard(totals, seed), "agent")
    assert board["always_cooperate"].taux_pardon is None


def test_self_play_is_one_match_of_two_seats(spark, seed):
    rows = seat_rows("self", "CCD", "CDC", a="random", b="random")
    totals = gold.match_totals(enrich(log(spark, rows)))
    row = gold.leaderboard(totals, seed).collect()[0]
    assert (row.n_matches, row.n_turns_joues) == (1, 6)
    cell = gold.matchup_matrix(totals).collect()[0]
    assert cell.n_matches == 1


def play(first: str, reply, length: int) -> tuple[str, str]:
    """A fixed sequence against a rule that sees it."""
    moves = ""
    for turn in range(length):
        moves += reply(first[:turn])
    return moves, first


def test_true_rules_have_their_signature(spark, seed):
    other = "CDDCDCCDCD" * 3
    mirror = play(other, lambda past: past[-1:] or "C", 30)
    grim = play(other, lambda past: "D" if "D" in past else "C", 30)
    rows = seat_rows("t", *mirror, a="tit_for_tat", b="random") + seat_rows(
        "g", *grim, a="grim_trigger", b="random"
    )
    totals = gold.match_totals(enrich(log(spark, rows)))
    board = rows_by(gold.leaderboard(totals, seed), "agent")
    for agent in ("tit_for_tat", "grim_trigger"):
        assert (board[agent].taux_pardon, board[agent].taux_riposte) == (0.0, 1.0)
    recip = rows_by(gold.reciprocity(totals), "agent")
    assert recip["tit_for_tat"].reciprocite == 1.0
    as_llm = [
        {**r, "player": "persona_rancunier", "player_type": "llm"}
        if r["player"] == "grim_trigger"
        else r
        for r in seat_rows("g", *grim, a="grim_trigger", b="random")
    ]
    _, followed = replayed(spark, seed, as_llm)
    assert fidelity.persona_fidelity(followed).collect()[0].fidelite == 1.0


def test_forgiveness_and_retaliation_add_up(bronze, seed):
    board = gold.leaderboard(gold.match_totals(enrich(bronze)), seed).collect()
    betrayed = [r for r in board if r.taux_pardon is not None]
    assert len(betrayed) >= 5
    for row in betrayed:
        assert math.isclose(row.taux_pardon + row.taux_riposte, 1.0)


def test_phi_on_counts_beyond_bigint_products(spark):
    from turnlake.functions.turns import phi

    n = 4 * 10**11
    df = spark.createDataFrame([(n, n // 2, n // 2, n // 2)], "n long, b long, x long, y long")
    assert df.selectExpr(phi("n", "b", "x", "y") + " AS r").collect()[0].r == 1.0


def test_phi_matches_a_direct_correlation(spark, seed):
    rows = random_rows(11, n_matches=30)
    silver = enrich(log(spark, rows))
    recip = rows_by(gold.reciprocity(gold.match_totals(silver)), "agent")
    for agent, row in recip.items():
        pairs = [
            (float(r.move == "C"), float(r.opponent_last_move == "C"))
            for r in silver.where(f"player = '{agent}'").collect()
            if r.opponent_last_move
        ]
        mx, my = (sum(p[i] for p in pairs) / len(pairs) for i in (0, 1))
        cov = sum((x - mx) * (y - my) for x, y in pairs)
        dev = math.sqrt(sum((x - mx) ** 2 for x, _ in pairs) * sum((y - my) ** 2 for _, y in pairs))
        assert math.isclose(row.reciprocite, cov / dev, rel_tol=1e-9)


def failures(df):
    return {(r.test, r.model, r.column): r.failures for r in df.collect()}


def test_data_tests_find_planted_faults(spark, seed):
    rows = seat_rows("m", *G1, a="persona_calculateur", a_type="llm", b="random")
    rows += rows[:1] + [{**rows[1], "turn": 9, "move": "X"}, {**rows[2], "turn": 8, "player": None}]
    fact = fact_of(spark, seed, rows)
    dim = gold.dim_agent(log(spark, rows[:1]), seed)
    assert failures(quality.accepted_values_tests(fact)) == {
        ("accepted_values", "fct_turns", "move"): 1,
        ("accepted_values", "fct_turns", "round_outcome"): 0,
    }
    assert failures(quality.model_tests(fact, "fct_turns", [], "turn_key")) == {
        ("unique", "fct_turns", "turn_key"): 1
    }
    # Six turns of "random" and the planted one have no parent; the NULL player does not count.
    assert failures(quality.relationship_tests(fact, dim)) == {
        ("relationships", "fct_turns", "player"): 7
    }
    assert failures(quality.model_tests(fact, "fct_turns", quality.FACT_KEYS)) == {
        ("not_null", "fct_turns", "turn_key"): 0,
        ("not_null", "fct_turns", "player"): 1,
    }
    assert failures(
        quality.model_tests(fact, "f", [*quality.FACT_KEYS, *quality.FACT_VALUES], "turn_key")
    ) == {
        ("not_null", "f", "turn_key"): 0,
        ("not_null", "f", "player"): 1,
        ("accepted_values", "f", "move"): 1,
        ("accepted_values", "f", "round_outcome"): 0,
        ("unique", "f", "turn_key"): 1,
    }
    names = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "name string")
    assert failures(quality.model_tests(names, "n", quality.not_null("name"), "name")) == {
        ("not_null", "n", "name"): 2,
        ("unique", "n", "name"): 1,
    }
    values = spark.createDataFrame([(-0.1,), (0.0,), (1.0,), (1.1,), (None,)], "fidelite double")
    assert failures(quality.range_tests(values)) == {
        ("accepted_range", "agg_persona_fidelity", "fidelite"): 2
    }


def test_payoff_check_sees_a_wrong_gain(spark):
    from turnlake.operators.bronze import payoff_matrix_check

    rows = seat_rows("m", "CCDD", "CDCD")
    good = payoff_matrix_check(log(spark, rows)).collect()[0]
    assert (good.temptation, good.reward, good.punishment, good.sucker) == (5, 3, 1, 0)
    assert all([good.is_consistent, good.matches_declared, good.is_ordered, good.beats_alternation])
    bad = payoff_matrix_check(log(spark, [{**rows[0], "payoff": 4}, *rows])).collect()[0]
    assert not bad.is_consistent and not bad.matches_declared
