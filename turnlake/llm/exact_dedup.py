"""Exact dedup by a split of heavy hitters: frequent digests never travel through a shuffle.

A Misra-Gries summary (Spark's ``approx_top_k``, a frequent-items sketch of that family) names
at most ``HEAVY`` digests that may be frequent. Their exact size and largest id come from an
aggregation that combines map-side, and the winners, at most ``HEAVY`` rows, are broadcast:
rows of those digests are decided where they are read. All others, each rarer than
rows / ``HEAVY`` or so, meet by an ordinary shuffle. Which digests the summary names affects
speed only, never the result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.llm.store import named, whole_row, written

# Digests decided by broadcast, and counters that the summary keeps to find them.
HEAVY = 256
COUNTERS = 4096


def text_digest(text: Column) -> Column:
    """SHA-256 in lowercase hex of the text with A-Z in lower case; null counts as empty."""
    lower = F.translate(
        F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase
    )
    return F.sha2(lower, 256)


def heavy_winners(digests: DataFrame) -> DataFrame:
    """(_digest, _winner, _size) of the digests that the summary names; at most ``HEAVY`` rows.

    ``digests`` holds ``_digest`` (binary) and ``_id``.
    """
    key = F.xxhash64("_digest")
    top = F.expr(f"explode(approx_top_k(_key, {HEAVY}, {COUNTERS}))")
    found = digests.select(key.alias("_key")).select(top.alias("_top"))
    named_keys = found.select(F.col("_top.item").alias("_key")).distinct()
    # 64-bit keys select; sizes are then counted by the whole digest.
    winners = (
        digests.withColumn("_key", key)
        .join(F.broadcast(named_keys), "_key", "left_semi")
        .groupBy("_digest")
        .agg(F.max("_id").alias("_winner"), F.count(F.lit(1)).alias("_size"))
        .orderBy(F.desc("_size"), "_digest")
        .limit(HEAVY)
    )
    return written(winners, "winners")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of rows with equal texts (A-Z in lower case, null as empty) the one with the largest id
    stays. Null ids come last; of rows that share text and id exactly one stays. A group
    whose ids are all null has a null ``keep_id`` and keeps one row. Other columns are not
    read, so their names never clash. No rows give no rows.
    """
    digests = written(
        docs.select(
            named(id_col).alias("_id"), F.unhex(text_digest(named(text_col))).alias("_digest")
        ),
        "digests",
    )
    matched = digests.join(F.broadcast(heavy_winners(digests)), "_digest", "left")
    lost = F.col("_size").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_winner"))
    beaten = matched.where(lost).select(
        "_id", "_digest", "_winner", "_size", F.lit(False).alias("_kept")
    )
    group = Window.partitionBy("_digest")
    # Winners of heavy digests come along to settle rows that repeat id and text.
    rest = matched.where(~lost).select(
        "_id",
        "_digest",
        F.coalesce("_winner", F.max("_id").over(group)).alias("_winner"),
        F.coalesce("_size", F.count(F.lit(1)).over(group)).alias("_size"),
        (F.row_number().over(group.orderBy(F.col("_id").desc_nulls_last())) == 1).alias("_kept"),
    )
    return beaten.unionByName(rest).select(
        F.col("_id").alias(id_col),
        F.col("_winner").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_kept").alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their own columns: one of each group of equal texts.

    The rules are those of ``exact_duplicates``. Rows that share text and id but differ
    elsewhere keep the one whose other columns hash lowest.
    """
    rows = docs.select(
        whole_row(docs).alias("_row"),
        named(id_col).alias("_id"),
        F.unhex(text_digest(named(text_col))).alias("_digest"),
    )
    digests = written(rows.select("_id", "_digest"), "digests")
    matched = rows.join(F.broadcast(heavy_winners(digests)), "_digest", "left")
    open_rows = matched.where(
        F.col("_size").isNull() | F.col("_id").eqNullSafe(F.col("_winner"))
    )
    order = Window.partitionBy("_digest").orderBy(
        F.col("_id").desc_nulls_last(), F.xxhash64("_row")
    )
    return (
        open_rows.withColumn("_place", F.row_number().over(order))
        .where("_place = 1")
        .select("_row.*")
    )


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
