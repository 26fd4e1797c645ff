"""Which matches a tournament should record, and which a turn log still lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.operators.skew import RANGE_ROWS, numbered_by_range
from turnlake.schemas import AGENTS


# Numbers in one array of a range.
STEP = 100_000


def match_id(a: Column, b: Column, n_turns: Column, repeat: Column) -> Column:
    return F.concat(
        a,
        F.lit("__vs__"),
        b,
        F.lit("__t"),
        n_turns.cast("string"),
        F.lit("__r"),
        repeat.cast("string"),
    )


def agent_order(players: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Distinct players of a log with their place: the known agents first, in their order.

    A task orders about ``range_rows`` names, whatever they begin with.
    """
    rank = F.coalesce(
        *[F.when(F.col("agent_name") == name, i) for i, name in enumerate(AGENTS)],
        F.lit(len(AGENTS)),
    )
    agents = (
        players.select(F.col("player").alias("agent_name"))
        .where(F.col("agent_name").isNotNull())
        .distinct()
    )
    return numbered_by_range(agents, [], [rank, F.col("agent_name")], "idx", range_rows)


def counted(df: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """Each row once for every number from ``first`` to ``last``.

    Numbers are made in two steps, so no array holds more than ``STEP`` of a long range but
    the one that counts its steps.
    """
    ends = df.withColumn("_first", first.cast("bigint")).withColumn("_last", last.cast("bigint"))
    steps = ends.where("_first <= _last").withColumn(
        "_step", F.explode(F.expr(f"sequence(0L, (_last - _first) div {STEP})"))
    )
    low = F.col("_first") + F.col("_step") * STEP
    numbers = F.sequence(low, F.least(F.col("_last"), low + (STEP - 1)))
    return steps.withColumn(name, F.explode(numbers)).drop("_first", "_last", "_step")


def schedule(
    agents: DataFrame, n_turns: int, n_repeats: int | Column, limit: int | None = None
) -> DataFrame:
    """Round robin with self-play: every unordered pair of agents, times the repeats.

    An agent names its partners by their index, so the pairing is an equi-join. With a limit,
    only agents, partners and repeats are made that the first ``limit`` matches can need.
    """
    last, repeats = agents.agg(F.max("idx")).scalar(), F.lit(n_repeats)
    partner = last
    firsts = agents
    if limit is not None:
        firsts = agents.where(F.col("idx") <= limit)
        partner = F.least(last, F.col("idx") + (limit - 1))
        repeats = F.least(repeats, F.lit(limit))
    a = counted(firsts, F.col("idx"), partner, "b_idx").select(
        F.col("idx").alias("a_idx"), F.col("agent_name").alias("a_player"), "b_idx"
    )
    b = agents.select(F.col("idx").alias("b_idx"), F.col("agent_name").alias("b_player"))
    pairs = a.join(b, "b_idx").withColumn("n_turns", F.lit(n_turns))
    pairs = counted(pairs, F.lit(1), repeats, "repeat")
    pairs = pairs.withColumn("repeat", F.col("repeat").cast("int"))
    ids = match_id(F.col("a_player"), F.col("b_player"), F.col("n_turns"), F.col("repeat"))
    return pairs.select(
        ids.alias("match_id"), "a_idx", "b_idx", "a_player", "b_player", "n_turns", "repeat"
    )


def first_matches(scheduled: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` matches, in the order in which the tournament plays them."""
    return scheduled.orderBy("a_idx", "b_idx", "repeat").limit(limit)


def pending_repeats(scheduled: DataFrame, turns: DataFrame) -> DataFrame:
    """Scheduled matches whose pair has not played that repeat, of whatever length."""
    recorded = turns.where("seat = 'A'").select(
        F.col("player").alias("a_player"), F.col("opponent").alias("b_player"), "repeat"
    )
    found = scheduled.join(recorded.distinct(), ["a_player", "b_player", "repeat"], "left_anti")
    return found.select(*scheduled.columns)


def pending(scheduled: DataFrame, turns: DataFrame) -> DataFrame:
    """Scheduled matches that the log does not hold."""
    recorded = turns.select("match_id").distinct()
    return scheduled.join(recorded, "match_id", "left_anti")


def match_seed(seed: int) -> Column:
    """A number per match that any process derives alike from the seed and the match id."""
    return F.crc32(F.concat(F.lit(f"{seed}:"), F.col("match_id")))


def sample_matches(turns: DataFrame, seed: int, keep: int, of: int) -> DataFrame:
    """The turns of about ``keep`` in ``of`` matches; whole matches, the same ones each time."""
    return turns.where(match_seed(seed) % of < keep)
