"""Audits of the models' raw answers, per agent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.functions import parse
from turnlake.functions.turns import named, ratio
from turnlake.schemas import TURN_KEY


def answers(turns: DataFrame) -> DataFrame:
    return turns.where("raw_output IS NOT NULL")


def stage_moves(turns: DataFrame) -> DataFrame:
    """What each stage alone reads in each answer."""
    stages = ["json_move", "letter_move", "keyword_move"]
    return parse.with_stages(answers(turns)).select(*TURN_KEY, "player", *stages)


def reparsed(turns: DataFrame) -> DataFrame:
    """The move read again from each answer, with the default for answers that state none."""
    return stage_moves(turns).selectExpr(
        *TURN_KEY,
        "player",
        f"coalesce({parse.EXTRACTED}, '{parse.DEFAULT_MOVE}') AS parsed_move",
        f"{parse.EXTRACTED} IS NOT NULL AS parsed_ok",
    )


def parse_audit(turns: DataFrame) -> DataFrame:
    """Answers per agent and deciding stage."""
    stage = """CASE WHEN json_move IS NOT NULL THEN 'json'
                    WHEN letter_move IS NOT NULL THEN 'letter'
                    WHEN keyword_move IS NOT NULL THEN 'keyword'
                    ELSE 'default' END AS stage"""
    staged = stage_moves(turns).selectExpr("player AS agent", stage)
    return staged.groupBy("agent", "stage").agg(*named({"n_answers": "count(*)"}))


def justification_rate(turns: DataFrame) -> DataFrame:
    """Share of answers per agent with a justification that is not blank."""
    text = parse.text_of(parse.field(F.col("payload"), "justification"))
    filled = F.coalesce(text.rlike(r"\S"), F.lit(False)).alias("filled")
    measures = {
        "n_answers": "count(*)",
        "n_justified": "count_if(filled)",
        "taux_justification": ratio("count_if(filled)", "count(*)"),
    }
    parsed = parse.with_payload(answers(turns).select("player", "raw_output"))
    checked = parsed.select(F.col("player").alias("agent"), filled)
    return checked.groupBy("agent").agg(*named(measures))


def payload_audit(turns: DataFrame) -> DataFrame:
    """Answers per agent that meet each demand of the declared answer format.

    The format is a JSON object with a required ``move`` of "C" or "D" and an optional
    ``justification`` string.
    """
    parsed = parse.with_payload(answers(turns).select("player", "raw_output"))
    payload = F.col("payload")
    move, why = parse.field(payload, "move"), parse.field(payload, "justification")
    checks = parsed.select(
        F.col("player").alias("agent"),
        parse.is_object(payload).alias("is_object"),
        move.isNotNull().alias("has_move"),
        parse.is_string(move).alias("is_text"),
        F.coalesce(parse.text_of(move).isin("C", "D"), F.lit(False)).alias("in_enum"),
        (why.isNull() | parse.is_string(why)).alias("why_ok"),
    )
    measures = {
        "n_answers": "count(*)",
        "n_object": "count_if(is_object)",
        "n_move": "count_if(has_move)",
        "n_move_string": "count_if(is_text)",
        "n_move_enum": "count_if(in_enum)",
        "n_valid": "count_if(in_enum AND why_ok)",
    }
    return checks.groupBy("agent").agg(*named(measures))
