"""N-gram Jaccard join: which documents share most of their word n-grams.

1. Each text becomes the set of its n-grams, as 64-bit hashes. Equal sets are one class.
2. Prefix filter. Two sets of similarity t share at least ``need`` of their
   ``size - ceil(t * size) + need`` smallest hashes. Only those prefixes are shuffled, packed
   by part of the hashes; a class stays if ``need`` of its prefix occur in another class. Tokens
   that a sample shows to be in very many prefixes need no counting, as they are shared for
   certain: their rows are packed by class, so no part holds all rows of such a token.
3. Of a class's prefix, ordered rarest first, one of the first tokens must occur in each of
   its partners. Classes joined by such tokens are a family: links exist inside families only.
4. The sets of a family meet in a prefix tree (``prefix_trie``). A family beyond
   ``CELL_TOKENS`` is cut into blocks, and each pair of blocks is a task of its own, so a cell
   is bounded and no pair is lost. A cell gives components and counts, never pairs.
5. Components of cells join up to those of documents.

Passages that many documents share are frequent tokens: they come last in the order and
neither make families nor get compared unless little else is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.llm.components import connected
from turnlake.llm.prefix_trie import join_sets
from turnlake.llm.store import hashed_below, named, text_batches, whole_row, written
from turnlake.llm.textbytes import shingle_hashes, text_chunks, word_hashes

# Prefix tokens that a counting task gets, and tokens of the sets in a block of a family.
PART_TOKENS = 500_000
CELL_TOKENS = 2_000_000
# A token in about so many prefixes, or in one of so many of all prefix tokens, is frequent: the
# frequent ones are a bounded list that each worker gets. One text in so many is sampled for them.
HOT_ROWS = PART_TOKENS // 16
MOST_HOT = 1 << 20
SAMPLED = 256
HALF = np.uint64(0xFFFFFFFF)


def ngram_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; null, empty and blank texts have none."""
    for first, end, data, offsets in text_chunks(texts):
        hashes, rows = shingle_hashes(*word_hashes(data, offsets), n, end - first)
        cuts = np.searchsorted(rows, np.arange(end - first + 1))
        for i in range(end - first):
            tokens = np.sort(hashes[cuts[i] : cuts[i + 1]])
            if len(tokens):
                tokens = tokens[np.append(True, tokens[1:] != tokens[:-1])]
            yield tokens


def set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(blake2b(tokens.tobytes(), digest_size=8).digest(), "big", signed=True)


def need(size, part: int, whole: int):
    """How many of the prefix's tokens must be shared."""
    return np.maximum(1, size * (whole - part) // whole)


def prefix_size(size, part: int, whole: int):
    return size - -(-size * part // whole) + need(size, part, whole)


def class_rows(n: int):
    """(id, mark, text) to (id, mark, size, set); the set's id is null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(t), set_id(t) if len(t) else None) for t in ngram_sets(batch.column(2), n)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([s for s, _ in sets], pa.int64()),
                    pa.array([i for _, i in sets], pa.int64()),
                ],
                names=["_id", "_mark", "_n", "_set"],
            )

    return run


def class_prefixes(texts: pa.Array, n: int, bar: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, sets): the prefixes of the classes among the texts, each class once."""
    tokens, owners = {}, []
    for t in ngram_sets(texts, n):
        if len(t) and (owner := set_id(t)) not in tokens:
            tokens[owner] = t[: prefix_size(len(t), *bar)]
            owners.append(np.full(len(tokens[owner]), owner, np.int64))
    if not tokens:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(list(tokens.values())), np.concatenate(owners)


def frequent_tokens(
    texts: DataFrame, n: int, bar: tuple[int, int], total: int
) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, estimates): tokens in ``HOT_ROWS`` prefixes or more, ascending, and in how many.

    Copies of a text are sampled together and count once. Where fewer than ``HOT_ROWS`` tokens are
    in all prefixes, none can be frequent. The estimates only have to put the tokens in an order
    that is the same for all classes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, owners = class_prefixes(batch.column(0), n, bar)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens.view(np.int64)), pa.array(owners)], names=["_token", "_set"]
            )

    least = max(HOT_ROWS, total // MOST_HOT)
    if total < least:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sample = texts.where(hashed_below(F.xxhash64("_text"), 1 / SAMPLED)).select("_text")
    pairs = sample.mapInArrow(run, "_token long, _set long").distinct()
    # Two classes in the sample are the proof that the token is shared.
    counts = pairs.groupBy("_token").count().where(F.col("count") >= max(2, least // SAMPLED))
    found = counts.toArrow()
    tokens = found["_token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found["count"].to_numpy()[order] * SAMPLED


def part_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    """The part, of ``parts``, that each token falls into by its lower half.

    The upper half would fill some parts only, as prefixes hold the smallest hashes.
    """
    return ((tokens & HALF) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def packed_prefixes(n: int, bar: tuple[int, int], parts: int, hot):
    """Texts to (part, tokens, sets): the prefixes of a batch's classes by part of the hashes.

    Frequent tokens, as places in the broadcast list ``hot``, go to ``parts`` further parts by set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = hot.value[0]
        for batch in batches:
            token, owner = class_prefixes(batch.column(0), n, bar)
            if not len(token):
                continue
            part = part_of(token, parts)
            if len(frequent):
                place = np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)
                is_hot = frequent[place] == token
                part = np.where(is_hot, parts + owner % parts, part)
                token = np.where(is_hot, place.astype(np.uint64), token >> np.uint64(32))
            else:
                token = token >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            token, owner, part = token[order].astype(np.uint32), owner[order], part[order]
            at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            ends = np.append(at[1:], len(part))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[at], pa.int64()),
                    pa.array([token[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()),
                    pa.array([owner[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()),
                ],
                names=["_part", "_tokens", "_sets"],
            )

    return run


def shared_tokens(parts: int, hot):
    """Of one part: (set, token, df) for tokens that occur in several classes."""

    def run(key, table):
        token = np.frombuffer(b"".join(table["_tokens"].to_pylist()), np.uint32)
        owner = np.frombuffer(b"".join(table["_sets"].to_pylist()), np.int64)
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        first = np.append(True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1]))
        token, owner = token[first], owner[first]
        part = key[0].as_py()
        if part >= parts:
            frequent, df = hot.value[0][token], hot.value[1][token]
            upper = (frequent >> np.uint64(32)).astype(np.int64)
            return pa.table({"_set": owner, "_token": upper | part_of(frequent, parts) << 32, "_df": df})
        _, at, df = np.unique(token, return_inverse=True, return_counts=True)
        df = df[at]
        many = df > 1
        whole = token[many].astype(np.int64) | (part << 32)
        return pa.table({"_set": owner[many], "_token": whole, "_df": df[many].astype(np.int64)})

    return run


def family_sets(n: int):
    """(family, set, size, copies, text) to the same with the set's tokens for the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = list(ngram_sets(batch.column(4), n))
            # Ids may repeat over texts; the set tells which text is meant.
            fits = [
                len(t) > 0 and set_id(t) == s
                for t, s in zip(tokens, batch.column(1).to_pylist(), strict=True)
            ]
            packed = pa.array([t.tobytes() for t in tokens], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], packed], names=["_family", "_set", "_n", "_copies", "_tokens"]
            ).filter(pa.array(fits, pa.bool_()))

    return run


def joined_cells(bar: tuple[int, int]):
    """Rows sorted by (family, i, j) to (set, root, links): one cell after another."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rows = sorted(rows, key=lambda r: r[3])
        ids = np.array([r[3] for r in rows], np.int64)
        sets = [np.frombuffer(r[7], np.uint64) for r in rows]
        i, j = rows[0][1:3]
        side = np.array([int(i != j and r[4] == j) for r in rows])
        root, links = join_sets(
            sets, np.array([r[5] for r in rows]), np.array([r[6] for r in rows]), side, bar, bool(i != j)
        )
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(ids[root]), pa.array(links)], names=["_set", "_root", "_links"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if rows and row[:3] != rows[0][:3]:
                    yield solve(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield solve(rows)

    return run


def linked_rows(
    docs: DataFrame, n: int, bar: tuple[int, int], id_col: str, text_col: str
) -> DataFrame:
    """(_id, _mark, _n, _root, _component, _links) of each row.

    ``_mark`` hashes the text; ``_root`` names the component and is null without words.
    """
    text_batches(docs.sparkSession)
    part, whole = bar
    id_type = docs.select(named(id_col)).schema[0].dataType
    texts = docs.select(named(id_col).alias("_id"), named(text_col).alias("_text"))
    fields = [
        T.StructField("_id", id_type),
        *[T.StructField(c, T.LongType()) for c in ("_mark", "_n", "_set")],
    ]
    marked = texts.select("_id", F.xxhash64("_text").alias("_mark"), "_text")
    rows = written(marked.mapInArrow(class_rows(n), T.StructType(fields)), "classes")
    classes = written(
        rows.where("_set IS NOT NULL")
        .groupBy("_set")
        .agg(F.max("_n").alias("_n"), F.min("_id").alias("_least"), F.count("*").alias("_copies")),
        "sets",
    )
    pairs_possible = classes.agg(F.sum("_n")).first()[0] or 0
    total = int(2 * pairs_possible * (whole - part) / whole)
    parts = 1 + total // PART_TOKENS
    hot = docs.sparkSession.sparkContext.broadcast(frequent_tokens(texts, n, bar, total))
    prefixes = texts.select("_text").mapInArrow(
        packed_prefixes(n, bar, parts, hot), "_part long, _tokens binary, _sets binary"
    )
    shared = prefixes.groupBy("_part").applyInArrow(
        shared_tokens(parts, hot), "_set long, _token long, _df long"
    )
    wanted = F.greatest(F.lit(1), F.expr(f"_n * {whole - part} div {whole}"))
    kept = (
        shared.groupBy("_set")
        .agg(F.sort_array(F.collect_list(F.struct("_df", "_token"))).alias("_shared"))
        .join(classes, "_set")
        .withColumn("_spare", F.size("_shared") - wanted + 1)
        .where("_spare > 0")
        # Rarest first: tokens of one class only come before these and match nobody.
        .select("_set", "_n", "_least", "_copies", F.expr("slice(_shared, 1, CAST(_spare AS INT))._token").alias("_signature"))
    )
    kept = written(kept, "candidates")
    signatures = kept.select("_set", F.explode("_signature").alias("_token"))
    leaders = signatures.groupBy("_token").agg(F.min("_set").alias("_leader"))
    star = signatures.join(leaders, "_token").select(
        F.col("_set").alias("a"), F.col("_leader").alias("b")
    )
    families = connected(star).withColumnsRenamed({"node": "_set", "root": "_family"})

    members = kept.drop("_signature").join(families, "_set")
    with_text = members.join(texts, F.col("_least").eqNullSafe(F.col("_id")))
    sets = with_text.select("_family", "_set", "_n", "_copies", "_text").mapInArrow(
        family_sets(n), "_family long, _set long, _n long, _copies long, _tokens binary"
    )
    sets = written(sets.dropDuplicates(["_set"]), "families")
    blocks = sets.groupBy("_family").agg(
        F.ceil(F.sum("_n") / CELL_TOKENS).alias("_blocks"), F.count("*").alias("_members")
    )
    placed = sets.join(blocks.where("_members > 1"), "_family").withColumn(
        "_block", F.pmod(F.xxhash64("_set"), F.col("_blocks"))
    )
    cells = placed.withColumn("_other", F.explode(F.expr("sequence(0L, _blocks - 1)"))).select(
        "_family",
        F.least("_block", "_other").alias("_i"),
        F.greatest("_block", "_other").alias("_j"),
        "_set",
        "_block",
        "_n",
        "_copies",
        "_tokens",
    )
    at = ["_family", "_i", "_j"]
    solved = written(
        cells.repartition(*at)
        .sortWithinPartitions(*at)
        .mapInArrow(joined_cells(bar), "_set long, _root long, _links long"),
        "cells",
    )
    roots = connected(solved.select(F.col("_set").alias("a"), F.col("_root").alias("b")))
    linked = solved.groupBy("_set").agg(F.sum("_links").alias("_links"))
    found = (
        classes.join(roots.withColumnRenamed("node", "_set"), "_set", "left")
        .join(linked, "_set", "left")
        .withColumn("_root", F.coalesce("root", "_set"))
    )
    least = found.groupBy("_root").agg(F.min("_least").alias("_component"))
    found = found.join(least, "_root").select(
        "_set",
        "_root",
        "_component",
        (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_links"),
    )
    return rows.join(found, "_set", "left").drop("_set")


def ngram_classes(
    docs: DataFrame, n: int, bar: tuple[int, int], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` and ``n_links``.

    Two documents link when ``bar[1] * |intersection| >= bar[0] * |union|`` of their distinct
    word ``n``-grams (A-Z in lower case); a text with fewer words is one n-gram. The component
    is the smallest id that links reach, the document's own included; ``n_links`` counts
    linked documents, copies too. Texts that are null, empty or blank have no n-grams and no
    links. Null ids are documents with a null id that count for no minimum; repeated rows are
    documents that link with each other. Columns but id and text are not read.
    """
    own = F.col("_root").isNull()
    return linked_rows(docs, n, bar, id_col, text_col).select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_shingles"),
        F.when(own, F.col("_id")).otherwise(F.col("_component")).alias("component_id"),
        F.coalesce("_links", F.lit(0)).alias("n_links"),
    )


def one_per_class(docs: DataFrame, n: int = 5, bar: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows that stay, with their own columns: of linked documents the smallest doc_id.

    Documents without words are linked with nothing, so all of them stay. A null id stays only
    if its whole group has null ids; of texts that share the smallest id, and of repeated
    rows, one stays, picked by hash.
    """
    found = linked_rows(docs, n, bar, "doc_id", "text")
    first = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_mark"))
    stays = found.where("_root IS NOT NULL").groupBy("_root").agg(first.alias("_first"))
    stays = stays.select("_first._id", "_first._mark", F.lit(True).alias("_single"))
    wordless = found.where("_root IS NULL").select("_id", "_mark", F.lit(False).alias("_single"))
    stays = stays.unionByName(wordless).distinct()
    rows = docs.select(
        whole_row(docs).alias("_row"),
        named("doc_id").alias("_key"),
        F.xxhash64(named("text")).alias("_text_mark"),
    )
    same = F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text_mark") == F.col("_mark"))
    place = F.row_number().over(
        Window.partitionBy("_key", "_text_mark").orderBy(F.xxhash64("_row"))
    )
    kept = rows.join(stays, same).withColumn("_place", place)
    return kept.where("_place = 1 OR NOT _single").select("_row.*")


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return ngram_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, (85, 100))


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2),
      lambda i: array_to_string(w[i:i + 3], ' '))) END AS g
  FROM d
), t AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS c FROM d UNION SELECT reach.doc_id, y FROM reach JOIN pairs ON c = x
), comp AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(g) AS n_shingles, component_id,
  (SELECT count(*) FROM pairs WHERE x = s.doc_id) AS n_links
FROM s JOIN comp USING (doc_id)
"""
