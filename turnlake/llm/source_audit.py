"""How far the sources of a language diverge in their words.

Arrow kernels turn texts into counts: a batch is put in lower case, split into terms, dictionary
encoded and grouped, all without a Python object per term. Tasks combine their batches before
they send partial counts. The merged counts are dealt into columnar shards of terms; a shard
holds a block of sources on each side, so it is bounded whatever the number of terms or sources,
and gives the partial divergences of its pairs and its part of each source's top terms.

A group's probability of a term is an integer, 1 + floor(SCALE * (count + 2) / (N + 2 * V)),
and the divergence of two probabilities is floor((p - q)^2 / (p + q)). All sums are of integers,
so results do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.llm.store import named, text_batches, written

# What separates terms, once A-Z is in lower case.
NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
# Documents of a language that a term must be in.
MIN_DOCS = 10
TOP_TERMS = 10
# The scale of probabilities in three steps, so that counts up to 9e15 cannot overflow.
SCALE_STEPS = (1000, 1000, 1000)
# Texts are split together up to this many bytes; a longer text is taken alone.
CHUNK_BYTES = 4 << 20
# Partial counts that a task holds before it combines them, and beyond which it sends them.
HELD_ROWS = 200_000
# Terms, and sources on each side, of one shard.
SHARD_TERMS = 4096
SHARD_SOURCES = 256

PARTIAL = "_lang string, _source string, _term string, _n long, _docs long"


def _by_bytes(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``CHUNK_BYTES`` of a text column."""
    ends = np.cumsum(pc.binary_length(batch.column(name)).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        start = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, start + CHUNK_BYTES, "right")))
        yield batch.slice(first, end - first)
        first = end


def chunk_counts(chunk: pa.RecordBatch) -> pa.Table:
    """Occurrences of each (language, source, term), and documents that hold it."""
    lists = pc.split_pattern_regex(pc.ascii_lower(chunk.column("_text")), NO_TERM)
    terms, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    holds = pc.not_equal(terms, "")
    coded = pc.filter(terms, holds).dictionary_encode()
    keys = pa.table({"row": pc.filter(rows, holds), "code": coded.indices})
    per_row = keys.group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    place = per_row["row"].combine_chunks()
    langs = chunk.column("_lang").dictionary_encode()
    sources = chunk.column("_source").dictionary_encode()
    table = pa.table(
        {
            "lang": pc.take(langs.indices, place),
            "source": pc.take(sources.indices, place),
            "code": per_row["code"],
            "n": per_row["count_all"],
        }
    )
    found = table.group_by(["lang", "source", "code"], use_threads=False).aggregate(
        [("n", "sum"), ("n", "count")]
    )
    return pa.table(
        {
            "_lang": pc.take(langs.dictionary, found["lang"]),
            "_source": pc.take(sources.dictionary, found["source"]),
            "_term": pc.take(coded.dictionary, found["code"]),
            "_n": found["n_sum"],
            "_docs": found["n_count"],
        }
    )


def merged(tables: list[pa.Table]) -> pa.Table:
    keys = ["_lang", "_source", "_term"]
    grouped = pa.concat_tables(tables).group_by(keys, use_threads=False)
    return grouped.aggregate([("_n", "sum"), ("_docs", "sum")]).rename_columns(
        [*keys, "_n", "_docs"]
    )


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a task's documents, combined as far as ``HELD_ROWS`` allows."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        for chunk in _by_bytes(batch, "_text"):
            held.append(chunk_counts(chunk))
            rows += held[-1].num_rows
            if rows > HELD_ROWS:
                held = [merged(held)]
                rows = held[0].num_rows
                if rows > HELD_ROWS // 2:
                    yield from held[0].to_batches()
                    held, rows = [], 0
    if held:
        yield from merged(held).to_batches()


def probabilities(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 2) / total), by long division; no count exceeds its total."""
    rest = counts + 2
    out = np.zeros_like(rest)
    for step in SCALE_STEPS:
        rest = rest * step
        out = out * step + rest // total
        rest = rest % total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    apart = p - q
    return apart * apart // (p + q)


SHARD_RESULT = "_lang string, _source string, _part string, _item string, _value long"


def shard_divergences(shard: pa.Table) -> pa.Table:
    """The pairs of one shard's two blocks of sources, and the best terms of each source.

    A row without a term stands for a source, with its words, those of its language, the number
    of terms that the language keeps and how many of them are in this shard.
    """
    lang = shard["_lang"][0].as_py()
    left, right = shard["_i"][0].as_py(), shard["_j"][0].as_py()
    heads = shard.filter(pc.is_null(shard["_term"]))
    body = shard.filter(pc.is_valid(shard["_term"]))
    names = heads["_source"].to_pylist()
    block = heads["_block"].to_numpy()
    kept_terms = 2 * heads["_kept"].to_numpy()
    totals = heads["_n"].to_numpy() + kept_terms
    coded = body["_term"].combine_chunks().dictionary_encode()
    width = len(coded.dictionary)
    out: list[tuple[str, str, str, int]] = []
    at_source = pc.index_in(body["_source"], value_set=heads["_source"].combine_chunks()).to_numpy()
    at_term = coded.indices.to_numpy()
    n = body["_n"].to_numpy()

    counts = np.zeros((len(names), width), np.int64)
    counts[at_source, at_term] = n
    if width:
        counts = probabilities(counts, totals[:, None])
    # Terms of this shard that none of these sources has.
    missing = heads["_shard_terms"].to_numpy()[0] - width
    absent = probabilities(np.zeros_like(totals), totals) if missing else np.ones_like(totals)
    first, second = np.flatnonzero(block == left), np.flatnonzero(block == right)
    for k, a in enumerate(first):
        others = second if left != right else first[k + 1 :]
        sums = divergence(counts[a][None], counts[others]).sum(axis=1)
        sums += missing * divergence(absent[a], absent[others])
        for b, value in zip(others, sums.tolist()):
            out.append((names[a], "pair", names[b], value))
            out.append((names[b], "pair", names[a], value))
    if left == right and width:
        p = counts[at_source, at_term]
        q = probabilities(
            body["_lang_n"].to_numpy(), (heads["_lang_n"].to_numpy() + kept_terms)[at_source]
        )
        value = divergence(p, q)
        over = np.flatnonzero(p > q)
        rank = np.empty(width, np.int64)
        rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(width)
        over = over[np.lexsort((rank[at_term[over]], -value[over], at_source[over]))]
        starts = np.searchsorted(at_source[over], np.arange(len(names)))
        place = np.arange(len(over)) - starts[at_source[over]]
        terms = coded.dictionary.to_pylist()
        for k in over[place < TOP_TERMS].tolist():
            out.append((names[at_source[k]], "term", terms[at_term[k]], int(value[k])))
    columns = list(zip(*out)) if out else [(), (), (), ()]
    types = [pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.table(
        [pa.array([lang] * len(out), pa.string())]
        + [pa.array(list(c), t) for c, t in zip(columns, types)],
        names=["_lang", "_source", "_part", "_item", "_value"],
    )


def divergence_audit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) that occurs.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z in lower case; a language
    keeps those in at least ``min_docs`` of its documents. Part ``pair`` gives the divergence
    from each other source of the language, summed over all kept terms (0 if there is none);
    part ``term`` the ``TOP_TERMS`` terms by which a source exceeds its language most. Ranks are
    by falling value, then by the item's UTF-8 bytes.

    Null texts, languages and sources count as empty ones. Repeated rows are documents like
    others. Further columns are not read, so their names cannot clash. A language of one source
    has no pairs; no rows give no rows.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(
        *[
            F.coalesce(named(c).cast("string"), F.lit("")).alias(name)
            for c, name in ((lang_col, "_lang"), (source_col, "_source"), (text_col, "_text"))
        ]
    )
    term = Window.partitionBy("_lang", "_term")
    counts = (
        rows.mapInArrow(partial_counts, PARTIAL)
        .groupBy("_lang", "_source", "_term")
        .agg(F.sum("_n").alias("_n"), F.sum("_docs").alias("_docs"))
        .withColumn("_lang_docs", F.sum("_docs").over(term))
        .withColumn("_lang_n", F.sum("_n").over(term))
        .withColumn("_first", F.row_number().over(term.orderBy("_source")) == 1)
        .where(F.col("_lang_docs") >= min_docs)
    )
    counts = written(counts.drop("_docs", "_lang_docs"), "terms")

    sums = counts.groupBy("_lang", "_source").agg(
        F.sum("_n").alias("_n"), F.count_if("_first").alias("_firsts")
    )
    groups = rows.select("_lang", "_source").distinct().join(sums, ["_lang", "_source"], "left")
    groups = written(groups.na.fill(0, ["_n", "_firsts"]), "sources")
    langs = written(
        groups.groupBy("_lang").agg(
            F.sum("_n").alias("_lang_n"),
            F.sum("_firsts").alias("_kept"),
            F.ceil(F.count("*") / SHARD_SOURCES).alias("_blocks"),
            F.greatest(F.lit(1), F.ceil(F.sum("_firsts") / SHARD_TERMS)).alias("_shards"),
        ),
        "languages",
    )
    block = F.pmod(F.xxhash64("_source"), F.col("_blocks")).alias("_block")
    shard = F.pmod(F.xxhash64("_term"), F.col("_shards"))
    body = counts.join(langs.drop("_lang_n"), "_lang").withColumn("_shard", shard)
    in_shard = body.groupBy("_lang", "_shard").agg(F.count_if("_first").alias("_shard_terms"))
    shards = F.explode(F.expr("sequence(0L, _shards - 1)")).alias("_shard")
    heads = groups.join(langs.select("*", shards), "_lang").join(
        in_shard, ["_lang", "_shard"], "left"
    )
    columns = ["_lang", "_source", "_term", "_n", "_lang_n", "_kept", "_shard_terms", "_blocks"]
    heads = heads.na.fill(0, ["_shard_terms"]).withColumn("_term", F.lit(None).cast("string"))
    heads = heads.select(*columns, "_shard", block)
    body = body.withColumn("_shard_terms", F.lit(0)).select(*columns, "_shard", block)
    # A block of sources meets every other block, and itself, once per shard of terms.
    cells = (
        heads.unionByName(body)
        .withColumn("_other", F.explode(F.expr("sequence(0L, _blocks - 1)")))
        .withColumn("_i", F.least("_block", "_other"))
        .withColumn("_j", F.greatest("_block", "_other"))
        .drop("_other", "_blocks")
    )
    parts = cells.groupBy("_lang", "_shard", "_i", "_j").applyInArrow(
        shard_divergences, SHARD_RESULT
    )
    item = ["_lang", "_source", "_part", "_item"]
    best = Window.partitionBy("_lang", "_source", "_part").orderBy(F.desc("_value"), "_item")
    return (
        parts.groupBy(*item)
        .agg(F.sum("_value").alias("_value"))
        .withColumn("_rank", F.row_number().over(best))
        .where((F.col("_part") == "pair") | (F.col("_rank") <= TOP_TERMS))
        .withColumnsRenamed({"_" + c: c for c in ("lang", "source", "part", "item", "value", "rank")})
        .select("lang", "source", "part", "item", "value", "rank")
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d
), kept AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), sizes AS (
  SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang
), grp AS (
  SELECT DISTINCT lang, source FROM d
), hits AS (
  SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term
), c AS (
  SELECT grp.lang, source, term, coalesce(hits.n, 0)::HUGEINT AS n
  FROM grp JOIN kept USING (lang) LEFT JOIN hits USING (lang, source, term)
), p AS (
  SELECT lang, source, term, n,
    1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v)::HUGEINT AS p
  FROM c JOIN sizes USING (lang)
), whole AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term
), q AS (
  SELECT lang, term, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v)::HUGEINT AS q
  FROM whole JOIN sizes USING (lang)
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), results AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part
    ORDER BY value DESC, encode(item))::INTEGER AS rank
  FROM results
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
