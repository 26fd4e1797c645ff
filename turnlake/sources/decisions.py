"""An event stream read as matches: each user's events become the decisions of one match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.operators.schedule import match_id
from turnlake.operators.skew import RANGE_ROWS, numbered, numbered_by_range
from turnlake.schemas import AGENTS

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
# Users per block, about, when a pair's matches are numbered.
USER_BLOCK = 1 << 20

# Agents by index; those from FIRST_PERSONA on are model-played.
FIRST_PERSONA = 5
_NAMES = "array(" + ", ".join(f"'{name}'" for name in AGENTS) + ")"


def matches(events: DataFrame, users_per_block: int = USER_BLOCK) -> DataFrame:
    """One match per user with at least two events: its agents, length, repeat and id.

    The ``repeat`` numbers the matches of a pair by user id. All matches fall on 36 pairs,
    so they are numbered by blocks of ids. A block is a part of the range that the ids span, so
    dense and hashed ids alike make blocks of about ``users_per_block`` users.
    """
    first, second = "user_id % 8", "user_id div 8 % 8"
    users = (
        events.groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n_events"))
        .where("n_events >= 2")
        .selectExpr(
            "*",
            f"CAST(least({first}, {second}) AS INT) AS ia",
            f"CAST(greatest({first}, {second}) AS INT) AS ib",
        )
    )
    ids = users.agg(F.expr("struct(min(user_id) AS low, max(user_id) AS high, count(*) AS n)"))
    spanned = ids.scalar()
    low, high = (spanned.getField(k).cast("double") for k in ("low", "high"))
    blocks = F.ceil(spanned.getField("n") / users_per_block)
    place = (F.col("user_id").cast("double") - low) / (high - low + 1)
    block = F.floor(place * blocks)
    named = numbered(users, ["ia", "ib"], [F.col("user_id")], block, "number").selectExpr(
        "user_id",
        "n_events",
        "ia",
        "ib",
        "CAST(number AS INT) AS repeat",
        "CAST(n_events div 2 AS INT) AS n_turns",
        *[f"{_NAMES}[i{s}] AS {s}_player" for s in "ab"],
        *[f"if(i{s} >= {FIRST_PERSONA}, 'llm', 'coded') AS {s}_type" for s in "ab"],
    )
    ids = match_id(F.col("a_player"), F.col("b_player"), F.col("n_turns"), F.col("repeat"))
    return named.withColumn("match_id", ids)


_EVENT = "struct(event_id, ts, event_type, value)"
_TURN = "CAST((rn + 1) div 2 AS INT) AS turn"


def turn_pairs(events: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows (user_id, turn, a, b): each user's events two by two, by time and event id.

    A trailing odd event has no partner and is dropped. Events are numbered by ranges of user,
    time and id, and the two of a turn meet on (user, turn), so no task orders all events of a
    user with very many, nor those of one moment.
    """
    order = [F.col("ts"), F.col("event_id")]
    return (
        numbered_by_range(events, ["user_id"], order, "rn", range_rows)
        .selectExpr("user_id", _TURN, "rn % 2 = 1 AS is_a", f"{_EVENT} AS event")
        .groupBy("user_id", "turn")
        .agg(
            F.expr("max(CASE WHEN is_a THEN event END) AS a"),
            F.expr("max(CASE WHEN NOT is_a THEN event END) AS b"),
        )
        .where("b IS NOT NULL")
    )


# What a decision means to play, and the shapes of a model's answer by the
# last digit of the event's id. Answers 8 and 9 state no move, which then is C.
_INTENDED = """CASE i{s} WHEN 0 THEN 'C' WHEN 1 THEN 'D'
  ELSE if({s}.event_type IN ('view', 'click', 'purchase'), 'C', 'D') END"""
_IS_PARSABLE = "({s}_type = 'coded' OR {s}.event_id % 10 < 8)"
_ANSWER = """CASE
  WHEN {s}_type = 'coded' THEN NULL
  WHEN {s}.event_id % 10 <= 4 THEN concat('{{"move": "', {s}_wish, '"}}')
  WHEN {s}.event_id % 10 = 5 THEN concat('{{"move": "',
    if({s}_wish = 'C', 'cooperate', 'defect'), '", "justification": "ok"}}')
  WHEN {s}.event_id % 10 = 6 THEN concat('Mon choix : ', {s}_wish)
  WHEN {s}.event_id % 10 = 7 THEN if({s}_wish = 'C', 'Je vais coopérer', 'Je vais trahir')
  WHEN {s}.event_id % 10 = 8 THEN 'coopérer ou trahir'
  ELSE '{{"move": "X"}}' END"""


def _decision(s: str) -> list[str]:
    """The columns of seat ``s``, read from its event."""
    columns = {
        "player": "{s}_player",
        "type": "{s}_type",
        "move": f"if({_IS_PARSABLE}, {{s}}_wish, 'C')",
        "response_time": "if({s}_type = 'llm', {s}.value, NULL)",
        "raw_output": _ANSWER,
        "is_parsable": _IS_PARSABLE,
    }
    return [f"{text.format(s=s)} AS {s}_{name}" for name, text in columns.items()]


def paired_decisions(events: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per turn with both seats' decisions (columns ``a_*`` and ``b_*``).

    Times with a zone are read in UTC, whatever the session's zone is.
    """
    if events.schema["ts"].dataType == T.TimestampType():
        seconds = "CAST(unix_micros(ts) AS DECIMAL(18, 0)) / 1000000"
        events = events.withColumn("ts", F.expr(f"{EPOCH} + make_dt_interval(0, 0, 0, {seconds})"))
    events = events.select("event_id", "ts", "user_id", "event_type", "value").where(
        "user_id IS NOT NULL AND ts IS NOT NULL"
    )
    # A user with very many turns is one row of the matches: a join that Spark can split.
    turns = turn_pairs(events, range_rows).join(matches(events), "user_id")
    moment = "replace(substring(CAST(a.ts AS STRING), 1, 19), ' ', 'T')"
    return turns.selectExpr(
        "*", *[f"{_INTENDED.format(s=s)} AS {s}_wish" for s in "ab"]
    ).selectExpr(
        "match_id",
        "repeat",
        "turn",
        "n_turns",
        *_decision("a"),
        *_decision("b"),
        "'fixture' AS run_id",
        f"concat({moment}, '+00:00') AS played_at",
    )
