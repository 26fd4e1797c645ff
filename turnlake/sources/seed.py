"""Agent attributes: the built-in table, or a CSV file of the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnlake.schemas import AGENT_META, SEED, inline_table


def seed_agents(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Empty CSV fields read as NULL."""
    if path is None:
        return inline_table(spark, SEED.names, AGENT_META)
    return spark.read.schema(SEED).csv(path, header=True)
