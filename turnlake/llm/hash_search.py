"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes: vectors are scaled into a ball, given one more coordinate that puts them on its sphere
(so the largest inner product is the smallest angle), rotated, and reduced to signs. The
rotations are learned on a bounded sample to make the signs fit the vectors (iterative
quantization); several of them give longer codes.

Index: a code is cut into substrings of ``SUBSTRING`` bits, and each block of vectors has a
table per substring from its value to the vectors that hold it. A query probes, in each table,
the values near its own: by the pigeonhole principle a code within ``radius`` of the query's is
near it in at least one substring, so every code within the radius is retrieved. What is
retrieved is checked by its whole code and ranked by the inner product of the original vectors.

Spark deals blocks of queries to blocks of vectors; a cell returns the best of its block for
each query, so pairs never leave a task. The radius is the one that keeps ``RECALL`` of
the neighbours that a few hundred rows of the sample have among all rows. Those are found by
comparing the few with every vector, in one reading, so the radius narrows as vectors get denser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.llm.store import hashed_below, named, written

# Vectors on which rotations and radius are learned, about.
SAMPLE_ROWS = 4000
ROTATIONS = 4
ITERATIONS = 25
SUBSTRING = 8
# Rows of the sample, at most, whose neighbours among all rows give the radius, and the share of
# those neighbours that it holds.
PROBE_ROWS = 400
RECALL = 0.98
NEIGHBOURS = 20
# Vectors in a block of the index, and queries in a block of theirs.
BLOCK_VECTORS = 16384
BLOCK_QUERIES = 32768
SEED = 5

_VALUES = np.arange(256, dtype=np.uint8)
_ONES = np.array([bin(v).count("1") for v in range(256)], np.uint8)
# Byte values by number of ones: XORed to a value they give its neighbours, nearest first.
_NEAR = _VALUES[np.argsort(_ONES, kind="stable")]
_WITHIN = np.cumsum(np.bincount(_ONES, minlength=9))


def learn_rotations(x: np.ndarray, scale: float) -> np.ndarray:
    """(rotations, dims + 1, dims + 1) for vectors whose norms are at most ``scale``."""
    z = on_sphere(x, scale)
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(ROTATIONS):
        r, _ = np.linalg.qr(rng.normal(size=(z.shape[1], z.shape[1])))
        for _ in range(ITERATIONS):
            u, _, v = np.linalg.svd(np.sign(z @ r).T @ z)
            r = v.T @ u.T
        out.append(r)
    return np.array(out)


def on_sphere(x: np.ndarray, scale: float) -> np.ndarray:
    """Vectors in a ball of radius ``scale`` as unit vectors with one more coordinate.

    A vector longer than the scale, which the sample had not, lies on the equator.
    """
    unit = x / scale
    rest = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1)))
    return np.column_stack([unit, rest])


def codes_of(z: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """(vector, substring) bytes; whole words of 64 bits where there are as many."""
    bits = np.concatenate([z @ r > 0 for r in rotations], axis=1)
    if bits.shape[1] >= 64:
        bits = bits[:, : bits.shape[1] // 64 * 64]
    return np.packbits(bits, axis=1)


def query_points(x: np.ndarray) -> np.ndarray:
    """Queries as unit vectors without the extra coordinate: only their direction counts."""
    return np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    if codes.shape[1] % 8 == 0 and codes.flags.c_contiguous:
        codes, code = codes.view(np.uint64), np.ascontiguousarray(code).view(np.uint64)
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int64)


def learn(spark: SparkSession, rows: DataFrame, k: int = NEIGHBOURS) -> dict:
    """Rotations from a sample of (_id, _vector), by hash of the id; a radius from all rows."""
    n, scale, dims = rows.agg(
        F.count("*"),
        F.max(F.expr("sqrt(aggregate(_vector, 0D, (s, x) -> s + x * x))")),
        F.max(F.size("_vector")),
    ).first()
    if not n:
        return {"scale": 1.0, "rotations": np.zeros((1, 1, 1)), "radius": 0}
    sample = rows.where(hashed_below(F.xxhash64("_id"), SAMPLE_ROWS / n) | F.lit(n <= 64))
    sample = sample.orderBy("_id").toArrow()
    x = np.array(sample["_vector"].to_pylist(), np.float64)
    if not len(x):
        x = np.eye(dims)[:1] * scale
    model = {"scale": scale, "rotations": learn_rotations(x, scale)}
    model["radius"] = codes_of(x[:1] @ np.eye(dims, dims + 1), model["rotations"]).shape[1] * 8
    ids = sample["_id"].to_numpy()[:: -(-len(x) // PROBE_ROWS)]
    asked = x[:: -(-len(x) // PROBE_ROWS)]
    # Up to k rows a query and task: the distances of its best vectors there.
    near = rows.mapInArrow(nearest_codes(ids, asked, model, k), "_query int, _product double, _bits int")
    order = Window.partitionBy("_query").orderBy(F.desc("_product"), "_bits")
    best = near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    # Distances are whole numbers of bits, so their counts tell any share exactly.
    counts = sorted((r["_bits"], r["count"]) for r in best.groupBy("_bits").count().collect())
    held = 0
    for bits, count in counts:
        held += count
        if held >= RECALL * sum(c for _, c in counts):
            model["radius"] = bits
            break
    return model


def nearest_codes(ids: np.ndarray, asked: np.ndarray, model: dict, k: int):
    """(_id, _vector) to the k largest products of each asked row and the codes' distances."""
    codes = codes_of(query_points(asked), model["rotations"]) if len(ids) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64))
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            x = matrix_of(batch.column(1))
            product = asked @ x.T
            product[ids[:, None] == batch.column(0).to_numpy()] = -np.inf
            at = np.argpartition(-product, min(k, len(x)) - 1, axis=1)[:, :k]
            stored = codes_of(on_sphere(x, model["scale"]), model["rotations"])
            bits = np.array([hamming(stored[p], c) for p, c in zip(at, codes, strict=True)])
            product = np.hstack([held[0], np.take_along_axis(product, at, 1)])
            bits = np.hstack([held[1], bits])
            at = np.argsort(-product, axis=1, kind="stable")[:, :k]
            held = np.take_along_axis(product, at, 1), np.take_along_axis(bits, at, 1)
        keep = np.isfinite(held[0])
        query = np.broadcast_to(np.arange(len(ids), dtype=np.int32)[:, None], keep.shape)
        columns = [query[keep], held[0][keep], held[1][keep].astype(np.int32)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns], names=["_query", "_product", "_bits"]
        )

    return run


def matrix_of(column: pa.Array) -> np.ndarray:
    """Vectors of one length, none of them null, as (row, component)."""
    return column.flatten().to_numpy().reshape(len(column), -1)


class Index:
    """One block of vectors with a table per substring."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, model: dict):
        self.ids, self.x, self.radius = ids, x, model["radius"]
        self.codes = codes_of(on_sphere(x, model["scale"]), model["rotations"])
        # Two sums of d products, in any order, differ by less than this times the query's norm.
        self.rounding = 4 * (x.shape[1] + 2) * np.finfo(np.float64).eps * np.linalg.norm(x, axis=1)
        # All tables in one array: by substring, then value.
        self.order = np.argsort(self.codes, axis=0, kind="stable").T.ravel()
        self.counts = np.concatenate([np.bincount(c, minlength=256) for c in self.codes.T])
        self.starts = np.cumsum(self.counts) - self.counts
        # Substrings 0..extra are probed one bit farther than the rest, which is enough.
        near, extra = divmod(self.radius, self.codes.shape[1])
        reach = [min(near if j <= extra else near - 1, 8) for j in range(self.codes.shape[1])]
        probes = [_NEAR[: _WITHIN[r] if r >= 0 else 0] for r in reach]
        self.table = np.repeat(np.arange(len(probes)), [len(p) for p in probes])
        self.flips = np.concatenate(probes)

    def within(self, code: np.ndarray) -> np.ndarray:
        """Places of all codes within the radius, by probing every table."""
        bucket = self.table * 256 + (self.flips ^ code[self.table])
        n = self.counts[bucket]
        at = np.repeat(self.starts[bucket] - np.cumsum(n) + n, n) + np.arange(n.sum())
        hit = np.zeros(len(self.ids), bool)
        hit[self.order[at]] = True
        places = np.flatnonzero(hit)
        return places[hamming(self.codes[places], code) <= self.radius]

    def best(self, query_id: int, query: np.ndarray, code: np.ndarray, k: int) -> np.ndarray:
        """Places of the k best of the retrieved vectors by score, then by id.

        Where fewer than k are retrieved, the whole block is ranked, so that a query never
        lacks neighbours.
        """
        places = self.within(code)
        places = places[self.ids[places] != query_id]
        if len(places) < k:
            places = np.flatnonzero(self.ids != query_id)
        if len(places) > k:
            # The product and the final score round differently: by this much at most.
            product = self.x[places] @ query
            error = self.rounding[places] * np.linalg.norm(query)
            bar = np.partition(product - error, -k)[-k]
            places = places[product + error >= bar]
            score = in_order(self.x[places], query)
            places = places[np.lexsort((self.ids[places], -score))[:k]]
        return places


def in_order(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component to the last, as the final score is."""
    return np.cumsum(x * query, axis=1)[:, -1]


def cell_search(model: dict, k: int):
    """Rows sorted by cell, vectors before queries, to (query, vector) candidates."""

    def solve(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_query = np.concatenate([p.column(2).to_numpy(zero_copy_only=False) for p in parts])
        if is_query.all() or not is_query.any():
            return
        ids = np.concatenate([p.column(3).to_numpy() for p in parts])
        x = np.concatenate([matrix_of(p.column(4)) for p in parts])
        index = Index(ids[~is_query], x[~is_query], model)
        asked, x = ids[is_query], x[is_query]
        codes = codes_of(query_points(x), model["rotations"])
        for query_id, query, code in zip(asked, x, codes, strict=True):
            places = index.best(query_id, query, code, k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(places), query_id, np.int64)),
                    pa.array(index.ids[places]),
                    list_of(np.broadcast_to(query, (len(places), len(query)))),
                    list_of(index.x[places]),
                ],
                names=["_query", "_found", "_q", "_v"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        cell = None
        for batch in batches:
            block, part = (batch.column(i).to_numpy() for i in (0, 1))
            new = np.flatnonzero((np.diff(block) != 0) | (np.diff(part) != 0)) + 1
            for start, end in zip([0, *new], [*new, batch.num_rows], strict=True):
                if start == end:
                    continue
                if parts and (block[start], part[start]) != cell:
                    yield from solve(parts)
                    parts = []
                cell = (block[start], part[start])
                parts.append(batch.slice(start, end - start))
        if parts:
            yield from solve(parts)

    return run


def list_of(x: np.ndarray) -> pa.Array:
    """(row, component) as an array of lists."""
    at = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(x).ravel()))


def neighbours(
    vectors: DataFrame,
    every: int = 20,
    k: int = NEIGHBOURS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's k nearest vectors found.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but the
    query's own; nearness is the inner product in double precision, ties go to the smaller
    id. Vectors that are null, zero, of another length than most or that hold null or
    non-finite components take no part, nor do null ids. Of rows that repeat an id one, the
    smallest vector, takes part. With fewer than k candidates all are returned, each ranked.
    Other columns are not read; no rows give no rows.
    """
    spark = vectors.sparkSession
    as_double = F.transform(named(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(named(id_col).cast("long").alias("_id"), as_double.alias("_vector"))
    finite = "forall(_vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    rows = rows.where(f"_id IS NOT NULL AND _vector IS NOT NULL AND {finite}")
    rows = rows.where("exists(_vector, x -> x <> 0)")
    rows = written(rows.groupBy("_id").agg(F.min("_vector").alias("_vector")), "vectors")
    sizes = rows.groupBy(F.size("_vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("_vector") == (sizes["n"] if sizes else 0))
    model = learn(spark, rows, k)
    n = rows.count()
    blocks = max(1, -(-n // BLOCK_VECTORS))
    query_blocks = max(1, -(-n // every // BLOCK_QUERIES))
    block = F.pmod(F.xxhash64("_id"), F.lit(blocks))
    query_block = F.pmod(F.xxhash64(F.lit(1), F.col("_id")), F.lit(query_blocks))
    stored = rows.select(
        block.alias("_block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("_part"),
        F.lit(False).alias("_is_query"),
        "_id",
        "_vector",
    )
    asked = rows.where(F.col("_id") % every == 0).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_block"),
        query_block.alias("_part"),
        F.lit(True).alias("_is_query"),
        "_id",
        "_vector",
    )
    cells = stored.unionByName(asked).repartition("_block", "_part")
    cells = cells.sortWithinPartitions("_block", "_part", "_is_query")
    found = cells.mapInArrow(
        cell_search(model, k), "_query long, _found long, _q array<double>, _v array<double>"
    )
    product = F.aggregate(F.zip_with("_q", "_v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = found.select("_query", "_found", product.alias("_score"))
    order = Window.partitionBy("_query").orderBy(F.desc("_score"), "_found")
    return (
        scored.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= k)
        .select(
            F.col("_query").alias("query_id"),
            F.col("_rank").alias("rank"),
            F.col("_found").alias("vec_id"),
            F.col("_score").alias("score"),
        )
    )


def op9_hash_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
