"""Quality by importance resampling: hashed n-gram models of target and raw text.

Words and pairs of words are hashed to ``BUCKETS``. Two bag models count them: the target model
over documents labelled good (at most about ``TARGET_ROWS``, by hash of the id), the raw model
over all documents. A document's log importance
weight is the log-likelihood ratio of its n-grams. Adding Gumbel noise to the weights and
taking the k largest samples k documents without replacement, in proportion to their weights.

Counts are sums by bucket of all rows, so the model has a fixed size; the k-th largest key is
found by narrowing its range with histograms, so no task ever sorts all keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.llm.store import hashed_below, named, text_batches, written
from turnlake.llm.textbytes import shingle_hashes, text_chunks, word_hashes

BUCKETS = 10_000
# Good labels, about, whose documents make the target model: their ids are broadcast.
TARGET_ROWS = 100_000
# Count that every bucket has beforehand.
SMOOTHING = 1.0
# Share of the documents that the sample holds.
KEEP = 0.5
SEED = 11
# Bins of each histogram on the way to the k-th largest key.
CUTS = 4096


def bucket_counts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every word and pair of words of the texts, chunk by chunk."""
    for first, end, data, offsets in text_chunks(texts):
        words, rows = word_hashes(data, offsets)
        pairs, pair_rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(words) > 1:
            pairs, pair_rows = shingle_hashes(words, rows, 2, end - first)
            counts = np.bincount(rows, minlength=end - first)
            many = counts[pair_rows] > 1  # one word alone is no pair
            pairs, pair_rows = pairs[many], pair_rows[many]
        hashes = np.concatenate([words, pairs]) % np.uint64(BUCKETS)
        yield np.concatenate([rows, pair_rows]) + first, hashes.astype(np.int64)


def count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, whether target) to (bucket, raw, target)."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        wanted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for rows, buckets in bucket_counts(batch.column(0)):
            raw += np.bincount(buckets, minlength=BUCKETS)
            target += np.bincount(buckets[wanted[rows]], minlength=BUCKETS)
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], names=["_bucket", "_raw", "_target"]
    )


def log_ratios(rows: DataFrame) -> np.ndarray:
    """Log of target over raw probability by bucket, from (_text, _good)."""
    counts = (
        rows.select("_text", "_good")
        .mapInArrow(count_buckets, "_bucket long, _raw long, _target long")
        .groupBy("_bucket")
        .agg(F.sum("_raw").alias("_raw"), F.sum("_target").alias("_target"))
        .toArrow()
    )
    sums = np.full((2, BUCKETS), SMOOTHING)
    at = counts["_bucket"].to_numpy()
    sums[0, at] += counts["_raw"].to_numpy()
    sums[1, at] += counts["_target"].to_numpy()
    logs = np.log(sums / sums.sum(axis=1, keepdims=True))
    return logs[1] - logs[0]


def gumbel(*parts: Column) -> Column:
    """A standard Gumbel number from a hash of the parts."""
    u = (F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of ``_key``, for k from 1 to the number of rows.

    Each round counts the keys of the present range in ``CUTS`` bins and goes on with the bin
    that holds the k-th, so a few rounds end at a single value.
    """
    low, high = keys.agg(F.min("_key"), F.max("_key")).first()
    while low < high:
        width = (high - low) / CUTS
        place = F.least(F.floor((F.col("_key") - low) / width), F.lit(CUTS - 1))
        bins = keys.where(F.col("_key").between(low, high)).groupBy(place.alias("bin"))
        bins = bins.agg(F.count("*").alias("n"), F.min("_key"), F.max("_key")).collect()
        for _, n, least, most in sorted(bins, reverse=True):
            if n >= k:
                low, high = least, most
                break
            k -= n
    return high


def resampled(
    docs: DataFrame,
    labels: DataFrame,
    keep: float = KEEP,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, ``n_grams``, ``log_weight``, ``score``, ``sample_key``, ``selected``.

    The target is the text of documents with label quality 1 (a sample of ``TARGET_ROWS`` where
    there are more), the raw text that of all documents. ``log_weight`` is the sum of log ratios, ``score`` (0 to 1) the logistic of 10
    times their mean. Selected are the ``ceil(keep * documents)`` largest keys, weight plus
    Gumbel noise, and every row that ties with the last of them. Null, empty and blank texts
    have weight 0 and score 0.5. Of several labels for an id the highest
    counts; without good ones all ratios are those of the smoothing. Repeated rows get equal
    keys, as the noise is a hash of id and text. Other columns are not read. No rows, no rows.
    """
    text_batches(docs.sparkSession)
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    good = written(good.withColumnRenamed("doc_id", "_label_id"), "good")
    few = hashed_below(F.xxhash64("_label_id"), TARGET_ROWS / max(1, good.count()))
    target = F.broadcast(good.where(few).withColumn("_good", F.lit(True)))
    rows = docs.select(named(id_col).alias("_id"), named(text_col).alias("_text"))
    marked = rows.join(target, F.col("_id") == F.col("_label_id"), "left").select(
        "_text", F.coalesce("_good", F.lit(False)).alias("_good")
    )
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(marked))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for row, bucket in bucket_counts(batch.column(1)):
                n += np.bincount(row, minlength=batch.num_rows)
                weight += np.bincount(row, ratios.value[bucket], batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n), pa.array(weight)],
                names=["_id", "_mark", "_n", "_weight"],
            )

    fields = [
        T.StructField("_id", rows.schema[0].dataType),
        *[T.StructField(n, t) for n, t in (("_mark", T.LongType()), ("_n", T.LongType()), ("_weight", T.DoubleType()))],
    ]
    weighed = rows.withColumn("_mark", F.xxhash64("_id", "_text")).mapInArrow(weigh, T.StructType(fields))
    keyed = written(weighed.withColumn("_key", F.col("_weight") + gumbel(F.col("_mark"))), "weights")

    k = math.ceil(keep * keyed.count())
    chosen = F.col("_key") >= kth_largest(keyed, k) if k else F.lit(False)
    mean = F.col("_weight") / F.greatest(F.col("_n"), F.lit(1))
    return keyed.select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_grams"),
        F.col("_weight").alias("log_weight"),
        (1 / (1 + F.exp(-10 * mean))).alias("score"),
        F.col("_key").alias("sample_key"),
        chosen.alias("selected"),
    )


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        spark.read.parquet(f"{sf_dir}/labels.parquet"),
    )
