"""The text that tells a player about the match so far."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentences of the summary.
FIRST_TURN = "Tour {turn} — première interaction, aucun historique disponible."
PLAYED = "Tour {turn} — {n} tour(s) joué(s)."
OPPONENT_RATE = "L'adversaire a coopéré {opp_coops}/{n} fois ({opp_percent}%)."
OWN_RATE = "Toi-même as coopéré {own_coops}/{n} fois ({own_percent}%)."
LAST_MOVE = "Au dernier tour, l'adversaire {last}."
LAST_COOPERATED = "a coopéré"
LAST_DEFECTED = "t'a trahi"
STREAK = "Trahisons consécutives actuelles de l'adversaire : {streak}."
SCORES = "Score cumulé — toi : {own_score}, adversaire : {opp_score}."


def fill(template: str, values: dict[str, Column]) -> Column:
    """The template as a column, with ``{name}`` replaced by that name's value."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        text, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(text), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves to the even neighbour."""
    share = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return F.bround(share * 100).cast("bigint")


def summary_text() -> Column:
    """Summary over the columns that ``operators.history.with_history`` adds."""
    n = F.col("turns_before")
    values = {
        "turn": n + 1,
        "n": n,
        "opp_coops": F.col("opp_coops_before"),
        "opp_percent": percent(F.col("opp_coops_before"), n),
        "own_coops": F.col("own_coops_before"),
        "own_percent": percent(F.col("own_coops_before"), n),
        "last": F.when(
            F.col("opponent_last_move").eqNullSafe("C"), LAST_COOPERATED
        ).otherwise(LAST_DEFECTED),
        "streak": F.col("opponent_defection_streak"),
        "own_score": F.col("own_score_before"),
        "opp_score": F.col("opp_score_before"),
    }
    sentences = [fill(s, values) for s in (PLAYED, OPPONENT_RATE, OWN_RATE, LAST_MOVE)]
    # concat_ws leaves the streak's sentence out where it is NULL.
    sentences.append(F.when(values["streak"] > 0, fill(STREAK, values)))
    sentences.append(fill(SCORES, values))
    return F.when(n == 0, fill(FIRST_TURN, values)).otherwise(F.concat_ws(" ", *sentences))
