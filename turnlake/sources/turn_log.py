"""Turn logs in Parquet: scan, overwrite, append, compact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.schemas import TURN_KEY, TURNS
from turnlake.sources import snapshots
from turnlake.sources.folders import names_in, remove
from turnlake.sources.key_index import recorded_runs, without_recorded, write_index
from turnlake.sources.sizing import sized_for
from turnlake.sources.snapshots import Conflict, Entry

# The load id of a log written as a whole.
BASE = "base"
# Files say by themselves whether they hold a match, with filters as large as their matches need.
MATCH_FILTERS = {
    "parquet.bloom.filter.enabled#match_id": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
}
# How often a writer starts again because another one was faster.
TRIES = 20


def scan_turns(
    spark: SparkSession, path: str, schema: T.StructType = TURNS
) -> DataFrame:
    """The log with its declared schema: no inference, columns a file lacks read as NULL.

    It is the state that the log has now. Files beside its folders would be passed over by the
    reader, so they are an error.
    """
    names = names_in(spark, path)
    if any(n.startswith((snapshots.BUILD, snapshots.LOAD)) for n in names) and any(
        n.endswith(".parquet") for n in names
    ):
        raise ValueError(f"{path} holds both files and load folders")
    return read_entries(spark, path, schema, snapshots.latest(spark, path).entries)


def read_entries(
    spark: SparkSession, path: str, schema: T.StructType, entries: list[Entry]
) -> DataFrame:
    """The rows of some of a log's folders."""
    # Without a log this fails, as reading any path that is not there does.
    folders = [f"{path}/{e.folder}".rstrip("/") for e in entries] or [path]
    return spark.read.schema(schema).parquet(*folders).select(*schema.names)


def scan_match(
    spark: SparkSession, path: str, match_id: str | None, schema: T.StructType = TURNS
) -> DataFrame:
    """The rows of one match, at the cost of that match rather than of the log.

    The key index names the folders that hold it; folders without an index are all looked into.
    In those, statistics and filters of the files leave few row groups to read. The match of null
    is the turns without an id; a match that the log lacks has no rows.
    """
    entries = snapshots.latest(spark, path).entries
    same = F.col("match_id").eqNullSafe(F.lit(match_id).cast("string"))
    wanted = spark.range(1).select(F.lit(match_id).cast("string").alias("match_id"))
    runs = recorded_runs(wanted, path, [e for e in entries if e.keys])
    hit = {r.folder for r in runs.where(same).select("folder").distinct().collect()}
    held = [e for e in entries if not e.keys or e.folder in hit]
    if entries and not held:
        return spark.createDataFrame([], schema)
    return read_entries(spark, path, schema, held).where(same)


def typed(turns: DataFrame) -> DataFrame:
    """The log with ``played_at`` as a timestamp."""
    return turns.withColumn("played_at", F.to_timestamp("played_at"))


def existing_match_ids(spark: SparkSession, path: str) -> DataFrame:
    """The matches a log holds, from that one column; none where there is no log yet."""
    entries = snapshots.latest(spark, path).entries
    if not entries:
        return spark.createDataFrame([], TURNS).select("match_id")
    return read_entries(spark, path, TURNS, entries).select("match_id").distinct()


def write_load(df: DataFrame, path: str, load_id: str | None) -> Entry:
    """Write the folder of a load, each file in the order of its matches where rows have any.

    It is no part of the log until a snapshot names it.
    """
    entry = Entry(load_id, snapshots.new_folder())
    rows = df.sortWithinPartitions("match_id") if "match_id" in df.columns else df
    rows.write.options(**MATCH_FILTERS).parquet(f"{path}/{entry.folder}")
    return entry


def drop_entries(spark: SparkSession, path: str, *entries: Entry) -> None:
    for entry in entries:
        for folder in filter(None, (entry.folder, entry.keys)):
            remove(spark, f"{path}/{folder}")


def overwrite(df: DataFrame, path: str, derived_from: list[str] | None = None) -> None:
    """Replace the whole log by these rows, as one load; ``derived_from`` notes their sources.

    The rows are complete before the log changes over, so a job that dies leaves the old log. The
    state before stays readable until the next change.
    """
    spark = df.sparkSession
    entry = write_load(df, path, BASE)
    for _ in range(TRIES):
        state = snapshots.latest(spark, path)
        try:
            return snapshots.publish(spark, path, state.next([entry], derived_from or []))
        except Conflict:
            continue
    raise Conflict(path)


def conform(turns: DataFrame) -> DataFrame:
    """The log's columns in order and type: missing ones NULL, unknown ones left out."""
    present = set(turns.columns)
    return turns.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TURNS.fields
        ]
    )


def union_relaxed(recorded: DataFrame, incoming: DataFrame) -> DataFrame:
    """Both logs under the declared schema, whichever columns each of them has."""
    return conform(recorded).unionByName(conform(incoming))


def without_copies(turns: DataFrame) -> DataFrame:
    """One of equal rows. They meet by key and hash, not by their whole content.

    They are shuffled as they come: Spark would first sort what each task has read.
    """
    rows = turns.withColumn("_content", F.xxhash64(*turns.columns)).repartition(*TURN_KEY)
    return rows.dropDuplicates([*TURN_KEY, "_content"]).drop("_content")


def unseen(incoming: DataFrame, recorded: DataFrame) -> DataFrame:
    """The incoming turns that are not recorded yet, by match, turn and seat.

    So late turns of a match that is recorded in part come in, too. Turns are compared one by
    one and spread by their whole key; missing parts of a key compare as equal.
    """
    rows, keys = incoming.alias("rows"), recorded.select(*TURN_KEY).alias("keys")
    same = " AND ".join(f"rows.{c} <=> keys.{c}" for c in TURN_KEY)
    return rows.join(keys, F.expr(same), "left_anti").select(*incoming.columns)


def indexed(spark: SparkSession, path: str, entries: list[Entry]) -> list[Entry]:
    """The entries with an index each; folders that were written without one get it now."""
    return [e if e.keys else write_index(spark, path, e) for e in entries]


def append_unseen(incoming: DataFrame, path: str, load_id: str) -> None:
    """Append the turns the log lacks; loading the same turns again adds nothing.

    The load looks its turns up in the buckets of the log's key index that its matches fall into,
    so its cost follows its own rows. It writes a folder of its own and publishes the log with it;
    if another load was faster, it looks again at the log as it is then. Running a load again
    under its id puts its folder anew, which repairs one that died half-way. Copies of a row
    within the load are dropped first.
    """
    spark = incoming.sparkSession
    rows = without_copies(conform(incoming))
    for _ in range(TRIES):
        state = snapshots.latest(spark, path)
        others = indexed(spark, path, [e for e in state.entries if e.load_id != load_id])
        runs = recorded_runs(rows, path, others)
        entry = write_load(without_recorded(rows, runs), path, load_id)
        entry = write_index(spark, path, entry)
        try:
            return snapshots.publish(spark, path, state.next([*others, entry]))
        except Conflict:
            drop_entries(spark, path, entry)
    raise Conflict(path)


def compact(spark: SparkSession, path: str, schema: T.StructType = TURNS) -> None:
    """Fold the folders of a log into one, with one index and its files in the order of the matches.

    Files hold ranges of matches and, of very long matches, ranges of turns. Loads that come in meanwhile stay beside it. Repeating a load that was folded in adds nothing.
    """
    state = snapshots.latest(spark, path)
    if len(state.entries) < 2:
        return
    folded = {e.folder for e in state.entries}
    rows = read_entries(spark, path, schema, state.entries).repartitionByRange(*TURN_KEY)
    with sized_for(spark, path):
        entry = write_load(rows.sortWithinPartitions(*TURN_KEY), path, BASE)
        entry = write_index(spark, path, entry)
    for _ in range(TRIES):
        now = snapshots.latest(spark, path)
        present = {e.folder for e in now.entries}
        if not folded <= present:  # a rebuild or a repeated load was faster
            break
        rest = [e for e in now.entries if e.folder not in folded]
        try:
            return snapshots.publish(spark, path, now.next([entry, *rest]))
        except Conflict:
            continue
    drop_entries(spark, path, entry)
    raise Conflict(path)
