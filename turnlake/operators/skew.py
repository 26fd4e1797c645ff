"""Orders that keep a key with very many rows out of a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of a range, about, how many keys are sampled for each, and how many ranges there are at
# most: their bounds are one array.
RANGE_ROWS = 1 << 20
RANGE_KEYS = 16
MOST_RANGES = 1 << 16
# Steps of a binary search among the bounds.
_STEPS = [1 << k for k in range(16, -1, -1)]


def numbered(
    df: DataFrame, keys: list[str], order: list[Column], block: Column, name: str
) -> DataFrame:
    """Add ``name``: the row number within ``keys`` in ``order``, as a BIGINT.

    ``block`` must not decrease along ``order``. Rows are numbered within (keys, block) and
    moved up by the rows of the earlier blocks, so a task sorts one block of a key and never
    the whole key; only the block counts of a key meet in one task. Every row in ``keys``
    and ``block`` must be non-null.
    """
    at = [*keys, "_block"]
    rows = df.withColumn("_block", block)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        rows.groupBy(*at)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*at, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    local = rows.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*at).orderBy(*order))
    )
    return (
        local.join(offsets, at)
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_block", "_local", "_offset")
    )


def with_range(
    df: DataFrame, order: list[Column], name: str, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Add ``name``: the number of the range of ``order``, ascending, that a row falls into.

    Ranges hold about ``range_rows`` rows each, however the values lie: their bounds are quantiles
    of a sample of the keys, at most ``RANGE_KEYS * MOST_RANGES`` of them. The sample is taken by
    hash, so every reading of the same rows gives the same ranges. Rows that are equal in all of
    ``order`` share a range. Nulls come first; up to ``range_rows`` rows are one range.
    """
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    keys = df.select(key.alias("_key"))
    n = keys.agg(F.count(F.lit(1))).scalar()
    ranges = F.least(F.ceil(n / range_rows), F.lit(MOST_RANGES))
    share = F.when(n > range_rows, ranges * RANGE_KEYS / n).otherwise(0.0)
    sampled = keys.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 40)) < share * float(1 << 40))
    bounds = sampled.distinct().agg(
        F.filter(
            F.sort_array(F.collect_list("_key")),
            lambda _, at: at % RANGE_KEYS == RANGE_KEYS - 1,
        )
    )
    steps = ", ".join(str(step) for step in _STEPS)
    # The bounds are looked up once: a second mention would copy them into every row.
    search = f"""aggregate(array({steps}), 0, (at, step) ->
        if(get(_bounds, at + step - 1) <= _key, at + step, at))"""
    return (
        df.withColumn("_key", key)
        .withColumn("_bounds", bounds.scalar())
        .withColumn(name, F.expr(search))
        .drop("_key", "_bounds")
    )


def numbered_by_range(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    name: str,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``numbered`` for any values of ``order``, which is ascending with nulls first.

    Ranges run through ``keys`` and ``order`` together, so a key with many rows falls into many
    ranges, whether its rows lie close together or far apart.
    """
    ranged = with_range(df, [*[F.col(k) for k in keys], *order], "_range", range_rows)
    return numbered(ranged, keys, order, F.col("_range"), name).drop("_range")
