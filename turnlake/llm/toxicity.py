"""Toxicity by class-conditional Kneser-Ney models of words, byte by byte.

The toxic and the ordinary model each hold their own counts of every beginning of a word: the
next byte given the whole word so far. What they back off to are continuation counts of short
byte n-grams, shared by both, so an expression too rare to tell the classes apart gets nearly
the same probability from either. A word's score is the log-likelihood ratio of its bytes. A
document's scores are the ratio per byte of its most toxic passages of 1, 4, 8 and 16 words,
wherever they begin, and of the whole text, so long clean stretches do not hide an insult. A text
of fewer words than a passage is one passage. A logistic curve, fitted on
scores by models that did not see the document, makes them a probability.

The class counts come from at most about ``TRAINING_ROWS`` labelled rows per class, by hash of
the id, and the shared continuation counts from all documents, labelled or not. The model
travels as sums by hash bin, at most ``BINS`` per table, whatever the corpus. Beginnings whose
counts the discount removes whole are left out: they change no probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.llm.bpe_encode import small_batches
from turnlake.llm.store import hashed_below, named, text_batches, whole_row, written
from turnlake.llm.textbytes import mixed

# Longest shared n-gram in bytes.
ORDER = 5
# Hash bins per table: a prime, which bounds the model.
BINS = 4_194_301
# Absolute discounts of the class counts and of the shared continuation counts.
CLASS_DISCOUNT = 2
DISCOUNT = 0.75
PASSAGES = (1, 4, 8, 16)
N_FEATURES = len(PASSAGES) + 2
# Bytes added to a length, so that a passage of one short word proves little.
LENGTH_PRIOR = 24
# Labelled rows per class, about, that are counted: their ids are broadcast.
TRAINING_ROWS = 100_000
# Labelled rows per class, about, on which the curve is fitted; a class is taken by its hash.
CURVE_ROWS = 10_000
# Words that a worker remembers.
CACHE_WORDS = 250_000
# A longer run of letters counts as several words.
WORD = re.compile(r"[^\W\d_]{1,40}")
TABLES = ("top", "context", "shared", "shared_context")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def positions(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of " word " for each word, the place of each byte in its word, and the word."""
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(b" " + r + b" " for r in raw), np.uint8).astype(np.int64)
    sizes = np.array([len(r) + 2 for r in raw], np.int64)
    word = np.repeat(np.arange(len(raw)), sizes)
    place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return data, place, word


def gram_keys(data: np.ndarray) -> list[np.ndarray]:
    """``keys[n]``: the n bytes that end at each position, packed; the last byte is lowest."""
    keys = [np.zeros(len(data), np.int64)]
    for n in range(1, ORDER + 2):
        key = keys[-1].copy()
        key[n - 1 :] |= data[: max(0, len(data) - n + 1)] << (8 * (n - 1))
        keys.append(key)
    return keys


def prefix_keys(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A 56-bit hash of the word's bytes up to each position; 0 before its first."""
    key = np.zeros(len(data), np.uint64)
    for p in range(1, int(place.max(initial=0)) + 1):
        at = np.flatnonzero(place == p)
        key[at] = mixed(key[at - 1] + data[at].astype(np.uint64) + np.uint64(1))
    return (key >> np.uint64(8)).astype(np.int64)


def bins(key, n):
    return (key * 8 + n) % BINS


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, class 0-3) to (word, n0, n1, n2, n3)."""
    counts = [Counter() for _ in range(4)]

    def told() -> pa.RecordBatch:
        words = list(set().union(*counts))
        columns = [pa.array(words, pa.string())]
        columns += [pa.array([c[w] for w in words], pa.int64()) for c in counts]
        return pa.RecordBatch.from_arrays(columns, names=["_word", "_0", "_1", "_2", "_3"])

    for batch in batches:
        for text, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[kind].update(words_of(text or ""))
        if sum(map(len, counts)) > CACHE_WORDS:
            yield told()
            counts = [Counter() for _ in range(4)]
    yield told()


def count_beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n0..n3) to (key, context, n0..n3) of the beginnings of words."""
    for batch in batches:
        for part in small_batches(batch, 50_000):
            weights = np.stack([part.column(k).to_numpy() for k in range(1, 5)])
            data, place, word = positions(part.column(0).to_pylist())
            keys = prefix_keys(data, place)
            at = np.flatnonzero(place >= 1)
            key, first, back = np.unique(keys[at], return_index=True, return_inverse=True)
            sums = [np.bincount(back, w[word[at]], len(key)).astype(np.int64) for w in weights]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(keys[at[first] - 1]), *map(pa.array, sums)],
                names=["_key", "_context", "_0", "_1", "_2", "_3"],
            )


def unread(keys: np.ndarray, told: np.ndarray) -> np.ndarray:
    """The distinct ``keys`` that are not in ``told``, ascending; ``told`` ascends, too."""
    keys = np.sort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    keys = keys[new]
    if not len(told):
        return keys
    return keys[told[np.minimum(np.searchsorted(told, keys), len(told) - 1)] != keys]


def distinct_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (key, n): the byte n-grams of the texts' words, mostly once per task."""
    told = [np.zeros(0, np.int64) for _ in range(ORDER + 2)]
    words: set[str] = set()
    read: set[str] = set()

    def flush() -> Iterator[pa.RecordBatch]:
        data, place, _ = positions(list(words))
        keys = gram_keys(data)
        for n in range(2, ORDER + 2):
            new = unread(keys[n][place >= n - 1], told[n])
            more = len(told[n]) < CACHE_WORDS
            told[n] = np.sort(np.concatenate([told[n], new])) if more else new
            yield pa.RecordBatch.from_arrays(
                [pa.array(new), pa.array(np.full(len(new), n, np.int32))], names=["_key", "_n"]
            )

    for batch in batches:
        for part in small_batches(batch):
            for text in part.column(0).to_pylist():
                words.update(words_of(text or ""))
            words -= read
            if len(words) > 50_000:
                yield from flush()
                read = words if len(read) > CACHE_WORDS else read | words
                words = set()
    yield from flush()


def model_tables(training: DataFrame, texts: DataFrame) -> dict[str, tuple]:
    """Class counts of ``training`` (_text, _kind) and continuation counts of ``texts`` (_text).

    The kind is 2 * toxic + half. At most ``BINS`` rows per table.
    """
    counts = [f"_{k}" for k in range(4)]
    sums = [F.sum(c).alias(c) for c in counts]
    words = training.select("_text", "_kind").mapInArrow(
        count_words, "_word string, _0 long, _1 long, _2 long, _3 long"
    )
    words = written(words.groupBy("_word").agg(*sums), "words")
    schema = "_key long, _context long, _0 long, _1 long, _2 long, _3 long"
    top = words.mapInArrow(count_beginnings, schema).groupBy("_key", "_context").agg(*sums)
    top = written(top, "beginnings")
    grams = texts.select("_text").mapInArrow(distinct_grams, "_key long, _n int").distinct()
    shared = (
        grams.withColumn("_key", F.expr("_key & (shiftleft(1L, 8 * (_n - 1)) - 1)"))
        .withColumn("_n", F.col("_n") - 1)
        .groupBy("_key", "_n")
        .agg(F.count("*").alias("_0"))
    )
    shared = written(shared, "continuations")
    # What the discount leaves to the backoff: by half and together.
    left = [f"least({c}, {CLASS_DISCOUNT})" for c in ("_0", "_1", "_0 + _1", "_2", "_3", "_2 + _3")]
    # A context none of whose counts exceeds the discount backs off whole, as an unseen one does.
    above = f"greatest(_0 + _1, _2 + _3) > {CLASS_DISCOUNT}"
    parts = {
        "top": (top.where(above), bins(F.col("_key"), F.lit(0)), counts),
        "context": (top, bins(F.col("_context"), F.lit(0)), [*counts, *left, f"int({above})"]),
        "shared": (shared, bins(F.col("_key"), F.col("_n")), ["_0"]),
        "shared_context": (shared, bins(F.shiftright("_key", 8), F.col("_n")), ["_0", "1"]),
    }
    tables = {}
    for name, (rows, where, values) in parts.items():
        totals = [F.sum(F.expr(v)).cast("float").alias(f"v{i}") for i, v in enumerate(values)]
        table = rows.groupBy(where.cast("int").alias("bin")).agg(*totals)
        if name == "context":
            table = table.where(f"v{len(values) - 1} > 0").drop(f"v{len(values) - 1}")
        columns = table.toArrow().sort_by("bin").columns
        tables[name] = (columns[0].to_numpy(), np.stack([c.to_numpy() for c in columns[1:]]))
    return tables


class Table:
    """Values by bin; bins that were never counted have 0."""

    def __init__(self, table: tuple[np.ndarray, np.ndarray]):
        bins, self.values = table
        # The column of each bin: 16 MB, and no search for the bins of a word's every byte.
        self.column = np.full(BINS, -1, np.int32)
        self.column[bins] = np.arange(len(bins), dtype=np.int32)

    def at(self, wanted: np.ndarray) -> np.ndarray:
        column = self.column[wanted]
        counted = np.flatnonzero(column >= 0)
        found = np.zeros((len(self.values), len(wanted)))
        for own, values in zip(found, self.values, strict=True):
            own[counted] = values[column[counted]]
        return found


class Words(dict):
    """Numbers words in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.ratio = np.zeros(0)
        self.size = np.zeros(0)

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number


class Models:
    """Both models. ``half``: count training rows of that half only; None: all."""

    def __init__(self, tables: dict[str, tuple], half: int | None = None):
        self.tables = {name: Table(tables[name]) for name in TABLES}
        self.half = half
        self.words = Words()

    def of_half(self, half: int) -> Models:
        """The models that count one half, over the same tables."""
        own = copy(self)
        own.half, own.words = half, Words()
        return own

    def _classes(self, values: np.ndarray) -> list[np.ndarray]:
        """Counts of the ordinary and of the toxic class from those of the four kinds."""
        if self.half is None:
            return [values[0] + values[1], values[2] + values[3]]
        return [values[self.half], values[2 + self.half]]

    def ratios(self, words: list[str]) -> np.ndarray:
        """log p(word | toxic) - log p(word | ordinary) of each word."""
        data, place, word = positions(words)
        at = np.flatnonzero(place >= 1)
        grams = gram_keys(data)
        p = np.full(len(at), 1 / 256)
        for n in range(1, ORDER + 1):
            use = place[at] >= n
            key = grams[n][at[use]]
            seen = self.tables["shared"].at(bins(key, n))[0]
            total, kinds = self.tables["shared_context"].at(bins(key >> 8, n))
            share = np.maximum(seen - DISCOUNT, 0) + DISCOUNT * kinds * p[use]
            p[use] = np.where(total > 0, share / np.maximum(total, 1), p[use])
        keys = prefix_keys(data, place)
        seen = self.tables["top"].at(bins(keys[at], 0))
        context = self.tables["context"].at(bins(keys[at - 1], 0))
        totals = self._classes(context)
        split = 2 if self.half is None else self.half
        logs = []
        for k, (count, total) in enumerate(zip(self._classes(seen), totals, strict=True)):
            left = context[4 + split + 3 * k]
            own = (np.maximum(count - CLASS_DISCOUNT, 0) + left * p) / np.maximum(total, 1)
            logs.append(np.log(np.where(total > 0, own, p) + 1e-12))
        return np.bincount(word[at], logs[1] - logs[0], len(words))

    def features(self, texts: list[str]) -> list[list[float]]:
        """Of each text: ratio per byte of its most toxic passage of each length, and of it all.

        The logarithm of the number of words follows: the maximum over more passages is
        higher by chance, and the curve takes that off.
        """
        if len(self.words) > CACHE_WORDS:
            self.words = Words()
        known = self.words
        number = known.__getitem__
        split = [np.array(list(map(number, words_of(t))), np.int64) for t in texts]
        if known.new:
            known.ratio = np.concatenate([known.ratio, self.ratios(known.new)])
            known.size = np.concatenate([known.size, [len(w) + 1.0 for w in known.new]])
            known.new = []
        return [self._features(known.ratio[n], known.size[n]) for n in split]

    def _features(self, ratio: np.ndarray, size: np.ndarray) -> list[float]:
        if not len(ratio):
            return [0.0] * N_FEATURES
        found = []
        ratios, sizes = (np.concatenate([[0.0], np.cumsum(x)]) for x in (ratio, size))
        for n in PASSAGES:
            n = min(n, len(ratio))
            per_byte = (ratios[n:] - ratios[:-n]) / (sizes[n:] - sizes[:-n] + LENGTH_PRIOR)
            found.append(float(per_byte.max()))
        whole = float(ratios[-1] / (sizes[-1] + LENGTH_PRIOR))
        return [*found, whole, float(np.log1p(len(ratio)))]


def fitted_curve(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Logistic weights (constant first) by Newton steps.

    Without rows of both classes nothing can be told, and every score is low.
    """
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    if not len(label) or label.min() == label.max():
        w[0] = -4.0
        return w
    ridge = np.diag([0.0] + [1e-3] * (len(w) - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = (x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(slope, x.T @ (label - p) - ridge @ w), -20, 20)
    return w


def training_labels(labels: DataFrame) -> DataFrame:
    """(_label_id, _toxic) outside the held-out fold, one row per document.

    Labels that are null, or not 0 or 1, are no labels; of several for a document the highest
    counts.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    known = known.groupBy(F.col("doc_id").alias("_label_id")).agg(
        F.max("toxic").cast("int").alias("_toxic")
    )
    return known.where(F.crc32(F.col("_label_id").cast("string")) % 5 != 0)


def some_of_each(known: DataFrame, rows: dict[int, int], bound: int) -> DataFrame:
    """About ``bound`` labels of each class, by hash of the id; ``rows``: how many there are."""
    picked = F.lit(False)
    for toxic, n in rows.items():
        few = hashed_below(F.xxhash64("_label_id"), bound / n)
        picked = picked | ((F.col("_toxic") == toxic) & few)
    return known.where(picked)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """(broadcast count tables, the curve's weights)."""
    text_batches(docs.sparkSession)
    known = written(training_labels(labels), "labels")
    n_rows = dict(map(tuple, known.groupBy("_toxic").count().collect()))
    texts = docs.select(named(id_col).alias("_id"), named(text_col).alias("_text"))
    half = F.pmod(F.xxhash64(F.lit(1), F.col("_label_id")), F.lit(2))

    def labelled(bound: int) -> DataFrame:
        # At most twice the bound in ids, so no text has to be shuffled to meet its label.
        few = F.broadcast(some_of_each(known, n_rows, bound))
        kind = (2 * F.col("_toxic") + half).cast("int").alias("_kind")
        return texts.join(few, F.col("_id") == F.col("_label_id")).select("_text", "_toxic", kind)

    tables = model_tables(labelled(TRAINING_ROWS), texts)
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    names = [f"f{k}" for k in range(N_FEATURES)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = Models(shared.value)
        other = [models.of_half(1), models.of_half(0)]
        for batch in batches:
            for part in small_batches(batch):
                texts, toxic, kinds = (c.to_pylist() for c in part.columns)
                found, labels = [], []
                for half in (0, 1):  # each half by the model that counts the other
                    own = [i for i, kind in enumerate(kinds) if kind % 2 == half]
                    found += other[half].features([texts[i] or "" for i in own])
                    labels += [toxic[i] for i in own]
                columns = [pa.array([f[k] for f in found], pa.float64()) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(labels, pa.int32())], names=[*names, "toxic"]
                )

    schema = ", ".join(f"{n} double" for n in names) + ", toxic int"
    scored = labelled(CURVE_ROWS).mapInArrow(score, schema).toArrow()
    scored = scored.sort_by([(n, "ascending") for n in scored.schema.names])
    x = np.column_stack([scored[n].to_numpy() for n in names])
    curve = fitted_curve(x, scored["toxic"].to_numpy().astype(np.float64))
    if len(n_rows) == 2:
        # The sample may hold a larger part of the toxic rows; the curve is for all of them.
        part = {k: min(1.0, CURVE_ROWS / n) for k, n in n_rows.items()}
        curve[0] += np.log(part[0] / part[1])
    return shared, curve


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score``, ``predicted``.

    A score reads the text alone. Null, empty and wordless texts have the score of a text
    without evidence. A null id is not held out. Repeated rows get equal scores. Without labels
    of both classes every score is low. Columns of ``docs`` but id and text are not read.
    """
    rows = docs.select(named(id_col).alias("_id"), named(text_col).alias("_text"))
    fields = [T.StructField("_id", rows.schema[0].dataType), T.StructField("_score", T.DoubleType())]
    score = scorer(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = score()
        for batch in batches:
            for part in small_batches(batch):
                scores = of(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), scores], names=["_id", "_score"])

    scored = rows.mapInArrow(run, T.StructType(fields))
    fold = F.crc32(F.col("_id").cast("string")) % 5
    return scored.select(
        F.col("_id").alias(id_col),
        F.coalesce(fold == 0, F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def scorer(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str):
    """What a task calls to get a function from texts to their scores."""
    shared, curve = learn(docs, labels, id_col, text_col)

    def start() -> Callable[[list[str | None]], pa.Array]:
        models = Models(shared.value)

        def scores(texts: list[str | None]) -> pa.Array:
            x = np.array(models.features([t or "" for t in texts]))
            z = curve[0] + x @ curve[1:]
            return pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return scores

    return start


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted toxic, with their own columns.

    Only texts go to Python and only scores come back, so rows stay where they are. Rows without
    words have the score of a text without evidence; null ids and repeated rows are rows like
    others. No rows give no rows.
    """
    start = scorer(docs, labels, "doc_id", "text")

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = start()
        for batch in texts:
            parts = [of(batch.slice(at, 256).to_pylist()) for at in range(0, len(batch), 256)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.float64())

    scored = docs.select(whole_row(docs).alias("_row"), score(named("text")).alias("_score"))
    return scored.where("_score < 0.5").select("_row.*")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        spark.read.parquet(f"{sf_dir}/labels.parquet"),
    )
