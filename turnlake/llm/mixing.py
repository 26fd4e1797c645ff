"""Mix sources to target weights in fixed-length blocks.

Each source is a stream of words, cut into blocks of ``BLOCK_WORDS``. The mix is a sequence of
slots in output shards of ``SHARD_SLOTS``. A shard gives each source the whole part of its
share and draws the remaining slots from the multinomial of the fractional parts. What the draws
of all shards give a source too much or too little is corrected behind its last slot, whose block
is cut where the target is reached, so every source gets its target to the word. The slots of a
source, numbered through all shards, map to its blocks by a pseudorandom permutation per pass
(a shorter last block stays the last), and blocks join the slots by (source, index). All draws are
hashes, so reruns agree.

Everything is DataFrame functions. Joins are on (source, block) or (source, bucket), so a hot
source spreads over its blocks; running offsets are taken per bucket of documents first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.llm.store import named, whole_row, written

BLOCK_WORDS = 64
SHARD_SLOTS = 8192
# Times a document may be used.
MAX_PASSES = 3
SEED = 20
# Groups of documents of one source whose offsets are summed apart.
BUCKETS = 512
# Multipliers of the index permutations: primes, so each is coprime to a length it doesn't divide.
PRIMES = (1000000007, 1000000009, 1000000021, 1000000033, 1000000087, 1000000093, 1000000097)
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def uniform(*parts) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


@dataclass
class Mix:
    """``rows``: one row per document with its place; ``sources``: one row per source;
    ``spans``: one row per slot and document part in it."""

    rows: DataFrame
    sources: DataFrame
    spans: DataFrame


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(_rid, _id, _mark, _source, _size), no texts; ``_mark`` hashes the whole row."""
    return docs.select(
        F.monotonically_increasing_id().alias("_rid"),
        named(id_col).alias("_id"),
        F.xxhash64(whole_row(docs)).alias("_mark"),
        named(source_col).alias("_source"),
        F.coalesce(F.regexp_count(named(text_col), F.lit(WORD)).cast("long"), F.lit(0)).alias(
            "_size"
        ),
    )


def source_targets(rows: DataFrame) -> DataFrame:
    """One row per source: number, words, weight, target, blocks and its share of slots.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share all words. A target
    stops at ``MAX_PASSES`` times its source's words; the excess is shared by weight among
    the others until none is above. The table has one row per source, a dimension.
    """
    words = rows.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    sources = written(
        words.withColumn("_s", F.row_number().over(order) - 1).withColumn(
            "_weight", (F.col("_s") % 3 + 1).cast("double")
        ),
        "sources",
    )
    cap = F.col("source_size") * float(MAX_PASSES)
    level = 0.0
    while True:  # each round caps at least one more source
        capped = F.col("_weight") * level >= cap
        free, open_weight = sources.agg(
            F.sum("source_size") - F.coalesce(F.sum(F.when(capped, cap)), F.lit(0.0)),
            F.sum(F.when(~capped, F.col("_weight"))),
        ).first()
        raised = free / open_weight if open_weight else level
        if raised <= level:
            break
        level = raised
    target = F.least(F.col("_weight") * level, cap)
    # The words to take: whole passes, and in the last pass as many words from its start.
    words = F.least(F.round(target).cast("long"), F.col("source_size") * MAX_PASSES)
    return sources.select(
        "_source",
        "_s",
        "source_size",
        target.alias("target"),
        F.expr(f"(source_size + {BLOCK_WORDS - 1}) div {BLOCK_WORDS}").alias("_blocks"),
        F.when(F.col("source_size") > 0, words).otherwise(0).alias("_take"),
    ).selectExpr(
        "*",
        "CASE WHEN source_size > 0 THEN _take div source_size ELSE 0L END AS _passes",
        "CASE WHEN source_size > 0 THEN _take % source_size ELSE 0L END AS _rest",
    ).selectExpr(
        "* EXCEPT (_passes, _rest)",
        f"_passes * _blocks + (_rest + {BLOCK_WORDS - 1}) div {BLOCK_WORDS} AS _slots",
        # Words of the last slot's block.
        f"CASE WHEN _rest % {BLOCK_WORDS} > 0 THEN _rest % {BLOCK_WORDS} ELSE {BLOCK_WORDS} END AS _limit",
    )


def placed(rows: DataFrame) -> DataFrame:
    """Add ``_start``: the words of the document's source before it.

    Offsets are summed within (source, bucket of ids) and moved up by the earlier buckets.
    """
    at = ["_s", "_bucket"]
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_id", "_mark"), F.lit(BUCKETS)))
    inside = Window.partitionBy(*at).orderBy("_id", "_mark", "_rid")
    earlier = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = (
        rows.groupBy(*at)
        .agg(F.sum("_size").alias("_words"))
        .select(*at, F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_before"))
    )
    local = F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("_local", local - F.col("_size"))
        .join(before, at)
        .withColumn("_start", F.col("_before") + F.col("_local"))
        .drop("_bucket", "_local", "_before")
    )


def numbers(
    first: Column, n: Column, name: str, df: DataFrame, step: int = 4096, spread: bool = False
) -> DataFrame:
    """Repeat each row for first..first+n-1, through arrays of at most about ``step`` numbers.

    ``spread`` deals the arrays of a row out to many tasks before their numbers are made.
    """
    out = df.withColumn("_n0", first.cast("long")).withColumn("_n1", F.col("_n0") + n - 1)
    chunks = F.expr(f"sequence(0L, (_n1 - _n0) div {step})")
    out = out.where("_n1 >= _n0").withColumn("_c", F.explode(chunks))
    if spread:
        # A fixed width: the rows are few and small before their numbers are made.
        width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = out.repartition(width, *df.columns, "_c")
    low = F.col("_n0") + F.col("_c") * step
    high = F.least(F.col("_n1"), low + step - 1)
    return out.withColumn(name, F.explode(F.sequence(low, high))).drop("_n0", "_n1", "_c")


def drawn(sources: DataFrame, shards: DataFrame, n_sources: int, slots: int, total: int) -> DataFrame:
    """(_shard, _s, _count): the fractional slots of these shards, drawn by the fractional parts.

    The unit interval is cut into as many buckets as there are sources, and a draw meets the
    sources whose intervals touch its bucket: about two, whatever their number.
    """
    rest = F.expr(f"(_slots * {slots}D / {total}) - floor(_slots * {slots}D / {total})")
    rising = Window.orderBy("_s")
    upto = sources.select("_s", rest.alias("_rest")).withColumn("_upto", F.sum("_rest").over(rising))
    left, end = upto.agg(F.sum("_rest"), F.max("_upto")).first()
    left = round(left or 0)
    ranges = upto.where("_rest > 0").select(
        "_s",
        ((F.col("_upto") - F.col("_rest")) / F.lit(end or 1.0)).alias("_low"),
        (F.col("_upto") / F.lit(end or 1.0)).alias("_high"),
    )
    # Each interval begins where the one before it ends, to the last digit.
    before = F.coalesce(F.lag("_high").over(rising), F.lit(0.0))
    ranges = ranges.withColumn("_low", before)
    touched = F.sequence(F.floor(F.col("_low") * n_sources), F.floor(F.col("_high") * n_sources))
    ranges = ranges.withColumn("_bucket", F.explode(touched))
    draws = numbers(F.lit(0), F.lit(left), "_draw", shards, spread=True)
    draws = draws.withColumn("_at", uniform(F.col("_shard"), F.col("_draw")))
    draws = draws.withColumn("_bucket", F.floor(F.col("_at") * n_sources))
    inside = draws.join(ranges, "_bucket").where("_low <= _at AND _at < _high")
    return inside.groupBy("_shard", "_s").agg(F.count("*").alias("_count"))


def drawn_slots(sources: DataFrame) -> DataFrame:
    """(_shard, _s, _first, _count): which slots of a source each shard gets."""
    spark = sources.sparkSession
    total, n_sources = sources.agg(F.sum("_slots"), F.count("*")).first()
    total = total or 0
    n_shards = max(1, -(-total // SHARD_SLOTS))
    last = total - (n_shards - 1) * SHARD_SLOTS
    some = sources.where("_slots > 0").select("_s", "_slots")
    width = F.when(F.col("_shard") == n_shards - 1, last).otherwise(SHARD_SLOTS).cast("double")
    every = numbers(F.lit(0), F.lit(n_shards), "_shard", some, spread=True)
    whole = F.floor(F.col("_slots") * width / F.lit(max(1, total))).alias("_count")
    union = every.select("_shard", "_s", whole)
    if total:
        for first, n, slots in ((0, n_shards - 1, SHARD_SLOTS), (n_shards - 1, 1, last)):
            shards = spark.range(first, first + n).select(F.col("id").alias("_shard"))
            union = union.unionByName(drawn(some, shards, n_sources, slots, total))
    counts = union.groupBy("_shard", "_s").agg(F.sum("_count").alias("_count"))
    earlier = Window.partitionBy("_s").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_first", F.coalesce(F.sum("_count").over(earlier), F.lit(0)))
    # Beyond a source's slots, draws have no effect; slots that no draw gave are in the last shard.
    counts = counts.join(some, "_s").withColumn(
        "_count",
        F.when(F.col("_shard") == n_shards - 1, F.col("_slots") - F.col("_first"))
        .otherwise(F.least("_count", F.col("_slots") - F.col("_first"))),
    )
    return counts.where("_count > 0").select("_shard", "_s", "_first", "_count")


def permuted(index: Column, n: Column, source: Column, turn: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 for each (source, turn): index times prime plus shift."""
    pick = F.pmod(F.xxhash64(F.lit(SEED + 1), source, turn), F.lit(len(PRIMES))).cast("int")
    primes = F.array(*[F.lit(p) for p in PRIMES])
    turned = F.concat(F.slice(primes, pick + 1, len(PRIMES)), F.slice(primes, 1, pick))
    prime = F.get(F.filter(turned, lambda p: n % p != 0), F.lit(0))
    shift = F.pmod(F.xxhash64(F.lit(SEED + 2), source, turn), n)
    # Products beyond a long are computed as decimals.
    wide = (index.cast("decimal(20,0)") * prime.cast("decimal(12,0)") + shift) % n.cast("decimal(20,0)")
    return F.when(n < 1 << 33, (index * prime + shift) % n).otherwise(wide.cast("long"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> Mix:
    """The mix of all documents.

    A document's size is its number of words (null or blank text: 0; such documents have a
    source but no part in the mix). Null is a source of its own, the last. Each source gives
    its target, rounded to words, and none of its documents is used more than ``MAX_PASSES``
    times. Null ids and repeated rows are documents like others. Names of
    further columns cannot clash. No rows, or no words, give no spans.
    """
    rows = written(sized(docs, id_col, text_col, source_col), "sized")
    sources = written(source_targets(rows), "targets")
    numbered = rows.join(
        sources.select(F.col("_source").alias("_name"), "_s", "source_size", "target"),
        F.col("_source").eqNullSafe(F.col("_name")),
    ).drop("_name")
    rows = written(placed(numbered), "placed")

    counts = drawn_slots(sources).join(sources.select("_s", "_blocks", "_slots", "_limit"), "_s")
    slots = numbers(F.col("_first"), F.col("_count"), "_slot", counts, spread=True)
    turn, index = F.expr("_slot div _blocks"), F.expr("_slot % _blocks")
    inner = F.greatest(F.lit(1), F.col("_blocks") - 1)
    slots = slots.select(
        "_shard",
        "_s",
        "_slot",
        turn.alias("_pass"),
        F.when(index == F.col("_blocks") - 1, index)
        .otherwise(permuted(index, inner, F.col("_s"), turn))
        .alias("_block"),
        F.when(F.col("_slot") == F.col("_slots") - 1, F.col("_limit"))
        .otherwise(BLOCK_WORDS)
        .alias("_words"),
    )
    # Written, so that the join knows how many slots there are.
    slots = written(slots, "slots")
    parts = numbers(
        F.expr(f"_start div {BLOCK_WORDS}"),
        F.expr(f"(_start + _size - 1) div {BLOCK_WORDS} - _start div {BLOCK_WORDS} + 1"),
        "_block",
        rows.where("_size > 0").select("_rid", "_id", "_mark", "_s", "_start", "_size"),
    ).select(
        "_rid",
        "_id",
        "_mark",
        "_s",
        "_block",
        "_size",
        F.greatest(F.lit(0), F.col("_block") * BLOCK_WORDS - F.col("_start")).alias("_from"),
        F.least(F.col("_size"), (F.col("_block") + 1) * BLOCK_WORDS - F.col("_start")).alias("_to"),
        (F.col("_block") * BLOCK_WORDS - F.col("_start")).alias("_block_at"),
    )
    spans = slots.join(parts, ["_s", "_block"])
    spans = spans.withColumn("_to", F.least("_to", F.col("_block_at") + F.col("_words")))
    return Mix(rows, sources, spans.where("_from < _to").drop("_block_at", "_words"))


def taken_words(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words taken."""
    m = mix(docs)
    used = m.spans.groupBy("_rid").agg(F.sum(F.col("_to") - F.col("_from")).alias("_taken"))
    return m.rows.join(used, "_rid", "left").select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        F.coalesce("_taken", F.lit(0)).alias("taken"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: the columns of ``docs``, a row for each part of a text taken.

    In each pass, the taken words of a document that follow each other are one row. A row
    that holds a whole document repeats it unchanged; a part holds those words with the
    space behind them, and its ``n_chars``, where there is such a column, is its own. Null
    and blank texts have no words and do not occur; null ids and repeated rows are documents
    like others; no rows give no rows.
    """
    m = mix(docs)
    block = Window.partitionBy("_rid", "_pass").orderBy("_from")
    gap = F.coalesce((F.lag("_to").over(block) != F.col("_from")).cast("int"), F.lit(1))
    runs = (
        m.spans.withColumn("_gap", gap)
        .withColumn("_run", F.sum("_gap").over(block))
        .groupBy("_rid", "_pass", "_run", "_id", "_mark", "_size")
        .agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    )
    # Repeated rows hold the same columns, so one of them serves all their parts.
    mark = F.xxhash64(whole_row(docs))
    rows = docs.select(
        whole_row(docs).alias("_row"), named("doc_id").alias("_key"), mark.alias("_row_mark")
    )
    one = Window.partitionBy("_key", "_row_mark").orderBy(F.lit(1))
    rows = rows.withColumn("_one", F.row_number().over(one)).where("_one = 1")
    same = F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_row_mark") == F.col("_mark"))
    joined = rows.join(runs, same)
    whole = (F.col("_from") == 0) & (F.col("_to") == F.col("_size"))
    words = F.regexp_extract_all(
        F.col("_row.text"), F.lit(f"(?:^{SPACE}+)?{WORD}{SPACE}*"), F.lit(0)
    )
    part = F.array_join(F.slice(words, F.col("_from").cast("int") + 1, (F.col("_to") - F.col("_from")).cast("int")), "")
    text = F.when(whole, F.col("_row.text")).otherwise(part)
    cut = joined.withColumn("_text", text)
    columns = []
    for name in docs.columns:
        value = F.col("_row")[name]
        if name == "text":
            value = F.col("_text")
        elif name == "n_chars":
            value = F.when(whole, value).otherwise(
                F.char_length("_text").cast(docs.schema[name].dataType)
            )
        columns.append(value.alias(name))
    return cut.select(*columns)


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    return taken_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
