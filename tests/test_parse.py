from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from games import log, seat_rows
from turnlake.functions import parse
from turnlake.operators import answers

# answer -> move, None where no stage reads one
ANSWERS = {
    '{"move":"C"}': "C",
    '{"move":"D"}': "D",
    '{"move":" defect "}': "D",
    '{"move":"\\u00a0\\u2003cooperate"}': "C",
    '{"move":"\\u001f d"}': "D",
    '{"move":"c"}': "C",
    ' \n{"justification":"x","move":"D"}\t': "D",
    '{"move":"cooperate"} then D': "D",
    '{"move":"X","move":"D"}': "D",
    '{"move":"cooperate","move":"defect"}': "D",
    '[{"move":"cooperate"}]': "C",
    '[{"move":"defect"}]': None,
    '{"move":"defect"}]': None,
    '{"move":"defect"}}': None,
    '{"move":"defect"}] }': None,
    '{"move":"defect"}, 5], [1': None,
    '{"move":"defect"},{"move":"defect"}': None,
    '{"move":"defect",}': None,
    "{'move':'defect'}": None,
    '{move:"defect"}': None,
    '{"move":"defect", "x": 01}': None,
    '{"move":"defect", "x": [1, {"y": null}]}': "D",
    '{"move":"defect", "x": }': None,
    '// note\n{"move":"defect"}': None,
    '{"move":5}': None,
    '{"move":null}': None,
    '{"move":true}': None,
    '{"move":["defect"]}': None,
    '{"move":{"move":"defect"}}': None,
    '{"move":""}': None,
    '{"move":"X"}': None,
    "{}": None,
    '"C"': "C",
    "null": None,
    "": None,
    "C": "C",
    "c": "C",
    "Mon choix : D": "D",
    "C'est D": "C",
    "d'accord": "D",
    "CD": None,
    "C3": None,
    "C_": None,
    "3 C": "C",
    "éC": None,
    "Cé": None,
    "C²": None,
    '{"move":"defect","x":NaN}': "D",
    '{"x":[Infinity, -Infinity],"move":"defect"}': "D",
    '{"move":NaN}': None,
    '{"move":"defect","x":"a, NaN, b"}': "D",
    '{"move":"defect","x":"\\", NaN, \\""}': "D",
    '{"move":"defect","x":NaNs}': None,
    '{"move":"defect","x":- Infinity}': None,
    '{NaN:1,"move":"defect"}': None,
    "C, puis D": "C",
    "«D»": "D",
    "JE VAIS COOPÉRER": "C",
    "je vais cooperer": "C",
    "Je vais trahir": "D",
    "TRAHISON": "D",
    "coopérer ou trahir": None,
    "je ne sais pas": None,
}


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(a,) for a in ANSWERS], "raw string")
    read = parse.with_stages(parse.with_payload(df, "raw").select(
        "raw", parse.is_object(F.col("payload")).alias("is_object")
    ), "raw")
    return {
        r.raw: r
        for r in read.selectExpr(
            "raw", f"{parse.EXTRACTED} AS move", "json_move", "is_object"
        ).collect()
    }


@pytest.mark.parametrize("answer", ANSWERS)
def test_move(parsed, answer):
    assert parsed[answer].move == ANSWERS[answer]


@pytest.mark.parametrize("answer", ANSWERS)
def test_payload_is_read_only_from_a_whole_json_object(parsed, answer):
    try:
        whole = isinstance(json.loads(answer), dict)
    except json.JSONDecodeError:
        whole = False
    assert parsed[answer].is_object == whole


def test_null_answer(spark):
    df = parse.with_stages(spark.sql("SELECT CAST(NULL AS STRING) AS raw"), "raw")
    assert df.selectExpr(f"{parse.EXTRACTED} AS move").collect()[0].move is None


def answer_log(spark, raws):
    rows = [
        {**seat_rows("m", "C", "C", a="persona_rancunier", turns=[i])[0], "raw_output": raw}
        for i, raw in enumerate(raws, 1)
    ]
    return log(spark, [*rows, *seat_rows("coded", "CD", "DC", a="random", b="random")])


def test_default_and_audits(spark):
    raws = ['{"move":"D"}', "C", "Je vais trahir", "rien", '{"move":"defect","justification":"ok"}']
    turns = answer_log(spark, [*raws, '{"move":"C","justification":5}', '{"move":"C","justification":" "}'])
    moves = {r.turn: (r.parsed_move, r.parsed_ok) for r in answers.reparsed(turns).collect()}
    assert len(moves) == 7
    assert moves[3] == ("D", True) and moves[4] == ("C", False)
    stages = {r.stage: r.n_answers for r in answers.parse_audit(turns).collect()}
    assert stages == {"json": 4, "letter": 1, "keyword": 1, "default": 1}
    rate = answers.justification_rate(turns).collect()[0]
    assert (rate.n_answers, rate.n_justified) == (7, 1)
    audit = answers.payload_audit(turns).collect()[0].asDict()
    assert audit == {
        "agent": "persona_rancunier",
        "n_answers": 7,
        "n_object": 4,
        "n_move": 4,
        "n_move_string": 4,
        "n_move_enum": 3,
        "n_valid": 2,
    }
