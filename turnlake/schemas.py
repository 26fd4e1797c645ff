"""Declared schemas and fixed values of the turn log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TURNS = T.StructType(
    [
        T.StructField("match_id", T.StringType()),
        T.StructField("seat", T.StringType()),
        T.StructField("repeat", T.IntegerType()),
        T.StructField("turn", T.IntegerType()),
        T.StructField("n_turns", T.IntegerType()),
        T.StructField("player", T.StringType()),
        T.StructField("player_type", T.StringType()),
        T.StructField("opponent", T.StringType()),
        T.StructField("opponent_type", T.StringType()),
        T.StructField("move", T.StringType()),
        T.StructField("opponent_move", T.StringType()),
        T.StructField("payoff", T.IntegerType()),
        T.StructField("opponent_payoff", T.IntegerType()),
        T.StructField("response_time", T.DoubleType()),
        T.StructField("raw_output", T.StringType()),
        T.StructField("is_parsable", T.BooleanType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("played_at", T.StringType()),
    ]
)

DERIVED = T.StructType(
    [
        T.StructField("own_cum_score", T.LongType()),
        T.StructField("opp_cum_score", T.LongType()),
        T.StructField("own_coop_rate", T.DoubleType()),
        T.StructField("opp_coop_rate", T.DoubleType()),
        T.StructField("opponent_last_move", T.StringType()),
        T.StructField("opponent_defection_streak", T.IntegerType()),
        T.StructField("forgave_this_turn", T.BooleanType()),
        T.StructField("retaliated_this_turn", T.BooleanType()),
        T.StructField("round_outcome", T.StringType()),
    ]
)

SILVER = T.StructType(TURNS.fields + DERIVED.fields)

# The staging projection keeps the derived columns next to the payoffs.
STAGING_COLUMNS = TURNS.names[:13] + DERIVED.names + TURNS.names[13:]

SEED = T.StructType(
    [
        T.StructField("agent_name", T.StringType()),
        T.StructField("agent_type", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("coded_equivalent", T.StringType()),
        T.StructField("equivalence", T.StringType()),
    ]
)

# One match is the turns of two seats; a seat within a match is one perspective.
PERSPECTIVE = ["match_id", "seat"]
TURN_KEY = ["match_id", "turn", "seat"]

# Payoffs of the game (own move, opponent move, own gain, opponent gain).
PAYOFFS = [
    ("C", "C", 3, 3),
    ("C", "D", 0, 5),
    ("D", "C", 5, 0),
    ("D", "D", 1, 1),
]

OUTCOMES = ["mutual_coop", "mutual_defect", "exploited", "exploiter"]

# The agents, in the order in which a tournament pairs them.
AGENTS = [
    "always_cooperate",
    "always_defect",
    "tit_for_tat",
    "random",
    "grim_trigger",
    "persona_empathique",
    "persona_calculateur",
    "persona_rancunier",
]

# Agent attributes
# (name, type, description, coded equivalent, kind of equivalence).
AGENT_META = [
    ("always_cooperate", "coded", "Coopere systematiquement", None, None),
    ("always_defect", "coded", "Trahit systematiquement", None, None),
    ("tit_for_tat", "coded", "Donnant-donnant : rejoue le dernier coup adverse", None, None),
    ("random", "coded", "Coup aleatoire a chaque tour", None, None),
    (
        "grim_trigger",
        "coded",
        "Coopere jusqu'a la 1re trahison adverse puis ne pardonne jamais",
        None,
        None,
    ),
    (
        "persona_empathique",
        "llm",
        "Cooperatif generaliste qui pardonne facilement une trahison isolee",
        "tit_for_tat",
        "approchee",
    ),
    (
        "persona_calculateur",
        "llm",
        "Reagit strictement au dernier coup adverse sans sentiment",
        "tit_for_tat",
        "stricte",
    ),
    (
        "persona_rancunier",
        "llm",
        "Coopere par defaut mais ne pardonne jamais apres une trahison",
        "grim_trigger",
        "stricte",
    ),
]


def sql_literal(value: str | int | None) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("'", "\\'") + "'"


def inline_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A constant relation. Spark knows its exact size, so a join with it is broadcast."""
    values = ", ".join("(" + ", ".join(map(sql_literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def payoff_table(spark: SparkSession) -> DataFrame:
    return inline_table(
        spark, ["move", "opponent_move", "payoff", "opponent_payoff"], PAYOFFS
    )
