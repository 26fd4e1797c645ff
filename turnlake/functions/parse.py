"""Reading a move out of a model's answer, as column expressions.

Order of the stages: the ``move`` string of a JSON object, an isolated letter, a French
keyword of exactly one family. What no stage reads counts as ``C`` and as not parsable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the answer formats.
LEADING_BLANKS = r"^[\s\x1c-\x1f]*"
LETTER_PATTERN = r"(?:^|[^\p{L}\p{N}_])([CD])(?:$|[^\p{L}\p{N}_])"
COOPERATE_PATTERN = "(?iu)coop[ée]r"
DEFECT_PATTERN = "(?iu)trah"
DEFAULT_MOVE = "C"
# NaN and the infinities as values, outside of strings: an even number of quotes follows.
BARE_NUMBERS = (
    r"(?<=[\[{:,\s])(?:NaN|-?Infinity)(?=\s*+[,\]}])"
    r'(?=[^"\\]*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"[^"\\]*+)*+$)'
)

_PAYLOAD = "move variant, justification variant, _corrupt string"
_STRICT_JSON = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_corrupt"}


def payload(raw: Column) -> Column:
    """The answer as a struct of variants, NULL unless it is one valid JSON object.

    The JSON functions ignore text after a value. Wrapping the answer as the only element
    of an array, and as the first of two, gives lengths 1 and 2 only when the answer is one
    whole value. NaN, Infinity and -Infinity count as values, which stricter readers refuse;
    none of them states a move. The field ``_corrupt`` is set where the fields could not be
    read; see ``field``.
    """
    raw = F.when(raw.rlike("NaN|Infinity"), F.regexp_replace(raw, BARE_NUMBERS, "null")).otherwise(raw)
    alone = F.json_array_length(F.concat(F.lit("["), raw, F.lit("]")))
    followed = F.json_array_length(F.concat(F.lit("["), raw, F.lit(",0]")))
    is_object = raw.rlike(r"^[ \t\r\n]*\{")
    fields = F.from_json(raw, _PAYLOAD, _STRICT_JSON)
    return F.when(is_object & (alone == 1) & (followed == 2), fields)


def is_object(parsed: Column) -> Column:
    return parsed.isNotNull() & parsed.getField("_corrupt").isNull()


def field(parsed: Column, name: str) -> Column:
    return F.when(is_object(parsed), parsed.getField(name))


def is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def text_of(value: Column) -> Column:
    return F.when(is_string(value), F.try_variant_get(value, "$", "string"))


def json_move(parsed: Column) -> Column:
    """The move of a parsed payload."""
    text = text_of(field(parsed, "move"))
    first = F.regexp_extract(text, "(?U)" + LEADING_BLANKS + "([CDcd])", 1)
    return F.nullif(F.upper(first), F.lit(""))


def letter_move(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(raw), LETTER_PATTERN, 1), F.lit(""))


def keyword_move(raw: Column) -> Column:
    cooperates, defects = raw.rlike(COOPERATE_PATTERN), raw.rlike(DEFECT_PATTERN)
    return F.when(cooperates & ~defects, "C").when(defects & ~cooperates, "D")


def with_payload(answers: DataFrame, raw: str = "raw_output") -> DataFrame:
    """Add ``payload``. A column of its own, so that its readers share one parse."""
    return answers.withColumn("payload", payload(F.col(raw)))


def with_stages(answers: DataFrame, raw: str = "raw_output") -> DataFrame:
    """Add what each stage alone reads: ``json_move``, ``letter_move``, ``keyword_move``."""
    return with_payload(answers, raw).withColumns(
        {
            "json_move": json_move(F.col("payload")),
            "letter_move": letter_move(F.col(raw)),
            "keyword_move": keyword_move(F.col(raw)),
        }
    ).drop("payload")


# The move the answer states, NULL where no stage reads one.
EXTRACTED = "coalesce(json_move, letter_move, keyword_move)"
