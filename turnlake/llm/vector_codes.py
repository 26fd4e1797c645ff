"""Vector code compression: k-means codebooks for the parts of a vector, with adaptive bounds.

Components become integers, and vectors are cut into ``PARTS`` equal parts with a codebook of up
to ``ENTRIES`` entries each. A part that has been assigned keeps its ``b`` next closest entries
with lower bounds of their distances, in rising order, and one bound of all other entries
(Drake and Hamerly). When the codebook moves, each bound falls by the movement of its entry, the
last one by the greatest movement. The distance to the part's own entry is computed anew. Entries
whose bound is above it cannot be nearer, so only those before are compared; if even the last
bound fails, all of them. ``b`` falls to the greatest depth that the round before used.

Bounds are integers, rounded down, and every comparison that a bound does not decide is one of
integer distances, so codes are those of plain k-means to the last tie. Each round writes the
vectors with their bounds to a table, which the next reads; only the codebooks, whose size does
not depend on the data, pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.llm.store import dropped, named, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024.0
# Bounds kept per part at first, and the fewest that later rounds keep.
FIRST_BOUNDS = 16
LEAST_BOUNDS = 2
# Distances, and components, that are computed at once.
BLOCK_CELLS = 1 << 21
# Integers up to here are exact as doubles.
EXACT = 1 << 53
LONG_MAX = (1 << 63) - 1


def largest_component(width: int) -> int:
    """The greatest component of vectors of that many components whose errors fit a long."""
    return isqrt((1 << 61) // max(1, width)) - 1


def integer_vectors(
    rows: DataFrame, id_col: str, vector_col: str, label_col: str
) -> tuple[DataFrame, int]:
    """(_id, _label, _vector) of the rows that take part, and the length of a part."""
    vector = named(vector_col)
    fails = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.where(vector.isNotNull() & ~fails)
    longest = kept.agg(F.max(F.size(vector))).first()[0] or 0
    part = -(-longest // PARTS)
    limit = float(largest_component(part * PARTS))

    def whole(x):
        scaled = F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(limit)), F.lit(-limit)))
        return scaled.cast("int")

    zeros = F.array_repeat(F.lit(0), F.lit(part * PARTS) - F.size(vector))
    return kept.select(
        named(id_col).alias("_id"),
        named(label_col).alias("_label"),
        F.concat(F.transform(vector, whole), zeros).alias("_vector"),
    ), part


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as int64 rows of ``width`` numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), width)


def sliced(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to a bounded number of components."""
    step = max(1, BLOCK_CELLS // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def lists(values: np.ndarray) -> pa.Array:
    """Rows of numbers as a list column."""
    rows, width = values.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32).ravel()))


def root_down(squares: np.ndarray) -> np.ndarray:
    """Integer square roots, rounded down."""
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    return root + ((root + 1) * (root + 1) <= squares)


def root_up(squares: np.ndarray) -> np.ndarray:
    root = root_down(squares)
    return root + (root * root < squares)


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries."""
    peak = max((int(np.abs(x).max()) for x in (points, entries) if x.size), default=0)
    if 4 * peak * peak * max(1, points.shape[1]) < EXACT:
        a, b = points.astype(np.float64), entries.astype(np.float64)
        out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * (a @ b.T)
        return out.astype(np.int64)
    out = np.zeros((len(points), len(entries)), np.int64)
    for k in range(points.shape[1]):
        apart = points[:, k, None] - entries[None, :, k]
        out += apart * apart
    return out


def full_search(points: np.ndarray, entries: np.ndarray, b: int):
    """(near, low, square): the ``b + 1`` closest entries, nearest and lowest first.

    ``low`` holds the bounds of all but the first of them, and that of all others at its end.
    """
    n, k = len(points), len(entries)
    near = np.zeros((n, b + 1), np.int64)
    low = np.zeros((n, b + 1), np.int64)
    square = np.zeros(n, np.int64)
    step = max(1, BLOCK_CELLS // max(1, k))
    for at in range(0, n, step):
        d = distances(points[at : at + step], entries)
        # Stable, so equal distances stay in the order of the entries.
        order = np.argsort(d, axis=1, kind="stable")[:, : b + 2]
        sorted_d = np.take_along_axis(d, order, axis=1)
        near[at : at + step] = order[:, : b + 1]
        square[at : at + step] = sorted_d[:, 0]
        low[at : at + step, :b] = root_down(sorted_d[:, 1 : b + 1])
        # With no further entry, the last bound is out of reach.
        low[at : at + step, b] = root_down(sorted_d[:, b + 1]) if b + 1 < k else 1 << 31
    return near, np.minimum(low, (1 << 31) - 1), square


def bounded_search(
    points: np.ndarray, near: np.ndarray, low: np.ndarray,
    entries: np.ndarray, moved: np.ndarray, b: int,
):
    """The same as ``full_search`` for a codebook that moved, from the bounds before.

    Returns also how many bounds each part needed, -1 for those that were searched in full.
    The kept entries are in the order of their bounds, which need not be that of distances.
    """
    n, kept = len(points), near.shape[1] - 1
    own = points - entries[near[:, 0]]
    square = (own * own).sum(axis=1)
    low = low.copy()
    low[:, :kept] -= moved[near[:, 1:]]
    low[:, kept] -= moved.max(initial=0)
    # A bound also holds for all entries behind it.
    low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1].clip(min=0)
    # Undecided: the bound is not above the distance to the part's own entry.
    open_bounds = (low * low <= square[:, None]).sum(axis=1)
    full = open_bounds > kept
    depth = np.where(full, -1, open_bounds)

    out_near, out_low = near[:, : b + 1].copy(), low[:, : b + 1].copy()
    # Bounds that are no longer kept go into the last one.
    out_low[:, b] = low[:, b]
    some = np.flatnonzero(~full & (open_bounds > 0))
    for z in np.unique(open_bounds[some]).tolist():
        rows = some[open_bounds[some] == z]
        among = near[rows, : z + 1]
        d = np.zeros(among.shape, np.int64)
        d[:, 0] = square[rows]
        for k in range(1, z + 1):
            apart = points[rows] - entries[among[:, k]]
            d[:, k] = (apart * apart).sum(axis=1)
        order = np.lexsort((among, d), axis=1)
        among = np.take_along_axis(among, order, axis=1)
        d = np.take_along_axis(d, order, axis=1)
        square[rows] = d[:, 0]
        merged_near, merged_low = near[rows].copy(), low[rows].copy()
        merged_near[:, : z + 1] = among
        merged_low[:, :z] = root_down(d[:, 1:])
        merged_low = np.minimum.accumulate(merged_low[:, ::-1], axis=1)[:, ::-1]
        out_near[rows], out_low[rows] = merged_near[:, : b + 1], merged_low[:, : b + 1]
    if full.any():
        found = full_search(points[full], entries, b)
        out_near[full], out_low[full], square[full] = found
    return out_near, np.minimum(out_low, (1 << 31) - 1), square, depth


def assigned(
    state: DataFrame, codebooks: np.ndarray, moved: np.ndarray | None, kept: int, b: int
) -> DataFrame:
    """The state with each part assigned to its nearest entry; ``moved`` None: no bounds yet."""
    parts, k, part = codebooks.shape
    sent = state.sparkSession.sparkContext.broadcast((codebooks, moved))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, shifts = sent.value
        for batch in sliced(batches, parts * part):
            n = batch.num_rows
            vectors = matrix(batch.column("_vector"), parts * part)
            near = np.zeros((n, parts, b + 1), np.int64)
            low = np.zeros((n, parts, b + 1), np.int64)
            squares = np.zeros((n, parts), np.int64)
            depths = np.full((n, parts), -1, np.int64)
            if shifts is not None:
                had_near = matrix(batch.column("_near"), parts * (kept + 1)).reshape(n, parts, -1)
                had_low = matrix(batch.column("_low"), parts * (kept + 1)).reshape(n, parts, -1)
            for q in range(parts):
                points = vectors[:, q * part : (q + 1) * part]
                if shifts is None:
                    near[:, q], low[:, q], squares[:, q] = full_search(points, books[q], b)
                else:
                    near[:, q], low[:, q], squares[:, q], depths[:, q] = bounded_search(
                        points, had_near[:, q], had_low[:, q], books[q], shifts[q], b
                    )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    batch.column("_label"),
                    batch.column("_vector"),
                    lists(near.reshape(n, -1)),
                    lists(low.reshape(n, -1)),
                    lists(near[:, :, 0]),
                    pa.array(squares.sum(axis=1)),
                    pa.array(depths.max(axis=1).astype(np.int32)),
                ],
                names=[*STATE, "_code", "_error", "_depth"],
            )

    first = [state.schema[c] for c in ("_id", "_label", "_vector")]
    numbers = T.ArrayType(T.IntegerType())
    fields = first + [
        T.StructField("_near", numbers),
        T.StructField("_low", numbers),
        T.StructField("_code", numbers),
        T.StructField("_error", T.LongType()),
        T.StructField("_depth", T.IntegerType()),
    ]
    return state.mapInArrow(run, T.StructType(fields))


STATE = ["_id", "_label", "_vector", "_near", "_low"]


def moved_codebooks(state: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Each entry at the rounded-down mean of its parts; entries without parts stay.

    Tasks send one sum per (part, entry, component) that they hold, so what is shuffled and
    collected is bounded by the codebooks' size.
    """
    parts, k, part = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, k, part + 1), np.int64)
        for batch in sliced(batches, parts * part):
            vectors = matrix(batch.column("_vector"), parts * part)
            codes = matrix(batch.column("_code"), parts)
            for q in range(parts):
                np.add.at(sums[q], (codes[:, q], slice(part)), vectors[:, q * part : (q + 1) * part])
                sums[q, :, part] += np.bincount(codes[:, q], minlength=k)
        used = np.argwhere(sums[:, :, part] > 0)
        if len(used):
            q, e = used.T
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((q * k + e).repeat(part + 1)),
                    pa.array(np.tile(np.arange(part + 1), len(used))),
                    pa.array(sums[q, e].ravel()),
                ],
                names=["_entry", "_at", "_sum"],
            )

    sent = state.select("_vector", "_code").mapInArrow(run, "_entry long, _at long, _sum long")
    totals = sent.groupBy("_entry", "_at").agg(F.sum("_sum").alias("_sum")).toPandas()
    flat = np.zeros((parts * k, part + 1), np.int64)
    flat[totals["_entry"], totals["_at"]] = totals["_sum"]
    used = flat[:, part] > 0
    out = codebooks.reshape(parts * k, part).copy()
    out[used] = flat[used, :part] // flat[used, part:]  # rounds down, negative sums too
    return out.reshape(parts, k, part)


def codebook_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def vector_codes(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    rounds: int = ROUNDS,
    first_bounds: int = FIRST_BOUNDS,
) -> DataFrame:
    """One row per vector: id, ``code``, ``error``, ``label_error`` and ``codebooks_sha256``.

    Rows take no part whose vector is null or holds a null or non-finite component. Components
    become floor(1024 * x). A codebook starts as the parts of the 256 vectors with the smallest
    ids (null ids last, repeated ids by their vectors), all of them if there are fewer; all
    distances and means are integers. ``label_error`` sums the errors of equal labels, null
    labels together, and stops at the greatest long.

    Vectors of unequal length, or of one that ``PARTS`` does not divide, count as filled up with
    zeros. Components so large that an error would not fit a long (beyond 180,000 in 64
    components) count as the largest that does. Repeated rows are vectors like others; columns
    but the three are not read. No vectors give no rows.
    """
    spark = rows.sparkSession
    vectors, part = integer_vectors(rows, id_col, vector_col, label_col)
    starts = vectors.orderBy(F.col("_id").asc_nulls_last(), "_vector").limit(ENTRIES)
    starts = [r._vector for r in starts.select("_vector").collect()]
    k = len(starts)
    codebooks = np.array(starts, np.int64).reshape(k, PARTS, part).transpose(1, 0, 2)
    if not k:
        codebooks = np.zeros((PARTS, 1, part), np.int64)
    b = min(first_bounds, max(0, k - 1))
    state = written(assigned(vectors, codebooks, None, 0, b), "codes")
    for _ in range(rounds):
        before, codebooks = codebooks, moved_codebooks(state, codebooks)
        apart = codebooks - before
        moved = root_up((apart * apart).sum(axis=2))
        deepest = state.agg(F.max("_depth")).first()[0] or 0
        kept = b
        if deepest > 0:
            b = min(kept, max(LEAST_BOUNDS, deepest))
        old, state = state, written(assigned(state.select(*STATE), codebooks, moved, kept, b), "codes")
        dropped(old)

    hexed = [F.lpad(F.lower(F.hex(F.get("_code", F.lit(q)))), 2, "0") for q in range(PARTS)]
    longest = F.lit(LONG_MAX).cast("decimal(38,0)")
    total = F.least(F.sum(F.col("_error").cast("decimal(19,0)")), longest).cast("long")
    sums = written(state.groupBy("_label").agg(total.alias("label_error")), "label_errors")
    sums = sums.withColumnRenamed("_label", "_name")
    return state.join(sums, F.col("_label").eqNullSafe(F.col("_name")), "left").select(
        F.col("_id").alias(id_col),
        F.concat(*hexed).alias("code"),
        F.col("_error").alias("error"),
        "label_error",
        F.lit(codebook_digest(codebooks)).alias("codebooks_sha256"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """Plain k-means over one row per component, a pair of common tables per round."""
    tables = []
    for k in range(ROUNDS + 1):
        tables.append(f"""a{k} AS MATERIALIZED (
  SELECT r, q, (min(d * {ENTRIES} + e) % {ENTRIES})::BIGINT AS e, min(d) AS d
  FROM (SELECT r, q, e, sum((x - c) * (x - c)) AS d FROM x JOIN c{k} USING (q, i) GROUP BY r, q, e)
  GROUP BY r, q
)""")
        if k < ROUNDS:
            tables.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT q, e, i, coalesce((s - ((s % n) + n) % n) // n, c)::BIGINT AS c
  FROM c{k} LEFT JOIN (
    SELECT q, e, i, sum(x) AS s, count(*) AS n FROM x JOIN a{k} USING (r, q) GROUP BY q, e, i
  ) USING (q, e, i)
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), x AS MATERIALIZED (
  SELECT r, (i - 1) * {PARTS} // len(embedding) AS q, i, floor(1024 * embedding[i]::DOUBLE)::BIGINT AS x
  FROM (SELECT r, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM kept)
), c0 AS MATERIALIZED (SELECT q, r - 1 AS e, i, x AS c FROM x WHERE r <= {ENTRIES}),
{", ".join(tables)}, coded AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY q) AS code, sum(d)::BIGINT AS error
  FROM a{ROUNDS} GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY q, e, i)) FROM c{ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""


ORACLE = _oracle()
