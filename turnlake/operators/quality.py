"""Data tests. Each returns rows (test, model, column, failures)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from turnlake.functions.turns import named
from turnlake.schemas import OUTCOMES


# A test of single rows: its name, the column, and SQL text that holds where a row fails.
RowTest = tuple[str, str, str]


def not_null(*columns: str) -> list[RowTest]:
    return [("not_null", c, f"{c} IS NULL") for c in columns]


def accepted_values(column: str, values: list[str]) -> list[RowTest]:
    """NULL is no value and does not fail."""
    accepted = ", ".join(f"'{v}'" for v in values)
    return [("accepted_values", column, f"{column} NOT IN ({accepted})")]


def accepted_range(column: str, low: float, high: float) -> list[RowTest]:
    """Both ends are accepted; NULL does not fail."""
    return [("accepted_range", column, f"{column} < {low} OR {column} > {high}")]


def model_tests(
    df: DataFrame, model: str, rows: list[RowTest], unique: str | None = None
) -> DataFrame:
    """Failures of the row tests and of a unique column, all from one pass over the model.

    The unique test counts values that occur more than once, NULL aside. Its grouping also
    carries the row tests' counts; copies of a value meet as partial counts.
    """
    failing = {f"c{i}": f"count_if({text})" for i, (_, _, text) in enumerate(rows)}
    if unique is None:
        counts = df.agg(*named(failing))
    else:
        values = df.groupBy(unique).agg(*named({"n": "count(*)", **failing}))
        sums = {c: f"coalesce(sum({c}), 0)" for c in failing}
        sums["repeated"] = f"count_if(n > 1 AND {unique} IS NOT NULL)"
        counts = values.agg(*named(sums))
    results = [(test, column, f"c{i}") for i, (test, column, _) in enumerate(rows)]
    if unique is not None:
        results.append(("unique", unique, "repeated"))
    structs = ", ".join(
        f"struct('{test}' AS test, '{model}' AS model, '{column}' AS column, {c} AS failures)"
        for test, column, c in results
    )
    return counts.selectExpr(f"inline(array({structs}))")


def relationships(
    child: DataFrame, model: str, column: str, parent: DataFrame, field: str
) -> DataFrame:
    """Child rows whose value has no parent; counted per value before the join."""
    values = (
        child.where(f"{column} IS NOT NULL").groupBy(column).agg(*named({"n": "count(*)"}))
    )
    known = parent.selectExpr(f"{field} AS {column}").distinct()
    orphans = values.join(known, column, "left_anti")
    return orphans.agg(*named({"failures": "coalesce(sum(n), 0)"})).selectExpr(
        "'relationships' AS test", f"'{model}' AS model", f"'{column}' AS column", "failures"
    )


def union_tests(tests: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tests)


FACT_KEYS = not_null("turn_key", "player")
FACT_VALUES = [
    *accepted_values("move", ["C", "D"]),
    *accepted_values("round_outcome", OUTCOMES),
]
FIDELITY_RANGE = accepted_range("fidelite", 0, 1)


def not_null_tests(
    fact: DataFrame, dim: DataFrame, fidelity: DataFrame, silver: DataFrame
) -> DataFrame:
    return union_tests(
        [
            model_tests(fact, "fct_turns", FACT_KEYS),
            model_tests(dim, "dim_agent", not_null("agent_name")),
            model_tests(fidelity, "agg_persona_fidelity", not_null("persona")),
            model_tests(silver, "silver.turns", not_null("match_id", "player")),
        ]
    )


def unique_tests(fact: DataFrame, dim: DataFrame, fidelity: DataFrame) -> DataFrame:
    return union_tests(
        [
            model_tests(fact, "fct_turns", [], "turn_key"),
            model_tests(dim, "dim_agent", [], "agent_name"),
            model_tests(fidelity, "agg_persona_fidelity", [], "persona"),
        ]
    )


def accepted_values_tests(fact: DataFrame) -> DataFrame:
    return model_tests(fact, "fct_turns", FACT_VALUES)


def relationship_tests(fact: DataFrame, dim: DataFrame) -> DataFrame:
    return relationships(fact, "fct_turns", "player", dim, "agent_name")


def range_tests(fidelity: DataFrame) -> DataFrame:
    return model_tests(fidelity, "agg_persona_fidelity", FIDELITY_RANGE)


def all_tests(
    fact: DataFrame, dim: DataFrame, fidelity: DataFrame, silver: DataFrame
) -> DataFrame:
    """The 13 declared tests, one pass per model and one for the relationship."""
    on_fidelity = [*not_null("persona"), *FIDELITY_RANGE]
    return union_tests(
        [
            model_tests(fact, "fct_turns", [*FACT_KEYS, *FACT_VALUES], "turn_key"),
            model_tests(dim, "dim_agent", not_null("agent_name"), "agent_name"),
            model_tests(fidelity, "agg_persona_fidelity", on_fidelity, "persona"),
            model_tests(silver, "silver.turns", not_null("match_id", "player")),
            relationship_tests(fact, dim),
        ]
    )
