"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads runs of text between white space, byte by byte in both directions, and labels
every byte position with a language; a document's probabilities pool the log-probabilities of
all its positions. Training is back-propagation through time in numpy, on a bounded sample of
labelled rows (``SAMPLE_ROWS`` per language), with Adam. A run's pooled labels depend on its
bytes alone, so tasks keep those of runs they have seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.llm.bpe_encode import small_batches
from turnlake.llm.store import hashed_below, named, text_batches

# Labelled rows per language that training reads, and runs of text that it draws from each.
SAMPLE_ROWS = 1000
RUNS_PER_ROW = 24
HIDDEN = 16
EMBEDDING = 12
# A longer run is read in parts of this many bytes.
RUN_BYTES = 32
BATCH = 256
EPOCHS = 3
RATE = 0.01
SEED = 7
CACHE_RUNS = 400_000
# Positions whose evidence counts as independent: of this many neighbours, one.
POOL = 4.0
LETTER = regex.compile(r"\p{L}")


def runs_of(text: str) -> list[bytes]:
    """The text's runs between white space that hold a letter, in lower case, cut to length."""
    found = []
    for word in text.lower().split():
        raw = word.encode()
        if len(raw) <= RUN_BYTES:
            found.append(raw)
        else:
            found += [raw[i : i + RUN_BYTES] for i in range(0, len(raw), RUN_BYTES)]
    return found


def padded(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(time, run) byte codes, 256 as padding, and the mask of real bytes."""
    steps = max(map(len, runs), default=0)
    codes = np.full((steps, len(runs)), 256, np.int64)
    for i, run in enumerate(runs):
        codes[: len(run), i] = np.frombuffer(run, np.uint8)
    return codes, (codes < 256).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def new_weights(n_labels: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    def normal(*shape: int) -> np.ndarray:
        return (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)

    weights = {"embed": normal(257, EMBEDDING) * 4}
    for side in "fb":  # forward and backward
        weights[f"in_{side}"] = normal(EMBEDDING, 3 * HIDDEN)
        weights[f"gate_{side}"] = normal(HIDDEN, 2 * HIDDEN)
        weights[f"state_{side}"] = normal(HIDDEN, HIDDEN)
        weights[f"bias_{side}"] = np.zeros(3 * HIDDEN, np.float32)
    weights["out"] = normal(2 * HIDDEN, n_labels)
    weights["out_bias"] = np.zeros(n_labels, np.float32)
    return weights


def read(w: dict[str, np.ndarray], side: str, codes: np.ndarray, mask: np.ndarray, trace: list | None):
    """Hidden states (time, run, unit) of one direction; padding leaves the state as it is."""
    steps, n = codes.shape
    table = w["embed"] @ w[f"in_{side}"] + w[f"bias_{side}"]  # what each byte adds to the gates
    states = np.zeros((steps, n, HIDDEN), np.float32)
    h = np.zeros((n, HIDDEN), np.float32)
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        x = table[codes[t]]
        gates = sigmoid(x[:, : 2 * HIDDEN] + h @ w[f"gate_{side}"])
        update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
        fresh = np.tanh(x[:, 2 * HIDDEN :] + (reset * h) @ w[f"state_{side}"])
        live = mask[t][:, None]
        if trace is not None:
            trace.append((t, h, update, reset, fresh))
        h = h + live * update * (fresh - h)
        states[t] = h
    return states


def position_logs(w: dict[str, np.ndarray], codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Log-probabilities (time, run, language) of every position."""
    states = np.concatenate([read(w, "f", codes, mask, None), read(w, "b", codes, mask, None)], axis=2)
    logits = states @ w["out"] + w["out_bias"]
    logits -= logits.max(axis=2, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))


def gradients(w: dict[str, np.ndarray], codes: np.ndarray, mask: np.ndarray, label: np.ndarray):
    """Gradients of the mean loss over positions, through time in both directions."""
    traces: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([read(w, s, codes, mask, traces[s]) for s in "fb"], axis=2)
    logits = states @ w["out"] + w["out_bias"]
    p = np.exp(logits - logits.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    p[:, np.arange(len(label)), label] -= 1
    p *= (mask / mask.sum())[:, :, None]
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["out"] = np.einsum("tnh,tnk->hk", states, p)
    g["out_bias"] = p.sum(axis=(0, 1))
    back = p @ w["out"].T
    for side, part in (("f", back[:, :, :HIDDEN]), ("b", back[:, :, HIDDEN:])):
        d_table = np.zeros((257, 3 * HIDDEN), np.float32)
        dh = np.zeros_like(part[0])
        gate, state = w[f"gate_{side}"], w[f"state_{side}"]
        for t, h, update, reset, fresh in reversed(traces[side]):
            dh = dh + part[t]
            live = mask[t][:, None] * dh
            d_fresh = live * update * (1 - fresh * fresh)
            d_update = live * (fresh - h) * update * (1 - update)
            through = d_fresh @ state.T
            d_reset = through * h * reset * (1 - reset)
            d_gates = np.concatenate([d_update, d_reset], axis=1)
            g[f"state_{side}"] += (reset * h).T @ d_fresh
            g[f"gate_{side}"] += h.T @ d_gates
            np.add.at(d_table, codes[t], np.concatenate([d_gates, d_fresh], axis=1))
            dh = dh - live * update + through * reset + d_gates @ gate.T
        g["embed"] += d_table @ w[f"in_{side}"].T
        g[f"in_{side}"] = w["embed"].T @ d_table
        g[f"bias_{side}"] = d_table.sum(axis=0)
    return g


def train(runs: list[bytes], label: np.ndarray, n_labels: int) -> dict[str, np.ndarray]:
    """The network's weights after ``EPOCHS`` passes of Adam over the runs."""
    rng = np.random.default_rng(SEED)
    w = new_weights(n_labels, rng)
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    steps = -(-len(runs) // BATCH) * EPOCHS
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(runs))
        for at in range(0, len(runs), BATCH):
            pick = order[at : at + BATCH]
            g = gradients(w, *padded([runs[i] for i in pick]), label[pick])
            step += 1
            rate = RATE * (1 - 0.9 * step / steps)
            for k in w:
                mean[k] = 0.9 * mean[k] + 0.1 * g[k]
                square[k] = 0.99 * square[k] + 0.01 * g[k] ** 2
                change = mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
                w[k] = (w[k] - rate * change).astype(np.float32)
    return w


class Runs(dict):
    """Numbers runs in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []
        self.logs: np.ndarray | None = None

    def __missing__(self, run: bytes) -> int:
        self.new.append(run)
        self[run] = number = len(self)
        return number


class Identifier:
    """Languages of texts by a trained network. ``cache`` keeps the runs that a worker has read."""

    def __init__(self, weights: dict[str, np.ndarray], languages: list[str], cache: dict):
        self.weights, self.languages, self.cache = weights, languages, cache

    def pooled(self, runs: list[bytes]) -> np.ndarray:
        """Sum of the positions' log-probabilities of each run."""
        out = np.zeros((len(runs), len(self.languages)))
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        for at in range(0, len(order), 4096):
            pick = order[at : at + 4096]
            codes, mask = padded([runs[i] for i in pick])
            out[pick] = (position_logs(self.weights, codes, mask) * mask[:, :, None]).sum(axis=0)
        return out

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """(text, language) probabilities from all positions of each text."""
        known = self.cache.get("runs")
        if known is None or len(known) > CACHE_RUNS:
            known = self.cache["runs"] = Runs()
            known.logs = np.zeros((0, len(self.languages)))
        number = known.__getitem__
        read_as = [np.array(list(map(number, runs_of(t))), np.int64) for t in texts]
        if known.new:
            known.logs = np.concatenate([known.logs, self.pooled(known.new)])
            known.new = []
        out = np.stack([known.logs[n].sum(axis=0) for n in read_as]) / POOL
        out -= out.max(axis=1, keepdims=True)
        p = np.exp(out)
        return p / p.sum(axis=1, keepdims=True)


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> pa.Table:
    """About ``SAMPLE_ROWS`` texts of each language outside the held-out fold, by hash."""
    rows = docs.select(
        named(id_col).alias("_id"), named(text_col).alias("_text"), named(lang_col).alias("_lang")
    ).where("_text IS NOT NULL AND _lang IS NOT NULL AND NOT crc32(CAST(_id AS STRING)) % 3 = 1")
    picked = F.lit(False)
    for lang, n in rows.groupBy("_lang").count().collect():
        few = hashed_below(F.xxhash64("_id", "_text"), SAMPLE_ROWS / n)
        picked = picked | ((F.col("_lang") == lang) & few)
    return rows.where(picked).select("_text", "_lang").toArrow().sort_by([("_lang", "ascending"), ("_text", "ascending")])


def learn(sample: pa.Table) -> tuple[dict[str, np.ndarray], list[str]]:
    """(weights, languages) from a table of texts and languages."""
    languages = sorted(set(sample["_lang"].to_pylist()))
    rng = np.random.default_rng(SEED)
    runs, label = [], []
    for text, lang in zip(sample["_text"].to_pylist(), sample["_lang"].to_pylist(), strict=True):
        own = [r for r in runs_of(text) if LETTER.search(r.decode(errors="replace"))]
        if own:
            picked = rng.choice(len(own), min(RUNS_PER_ROW, len(own)), replace=False)
            runs += [own[i] for i in picked]
            label += [languages.index(lang)] * len(picked)
    return train(runs, np.array(label, np.int64), len(languages)), languages


def languages_of(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred``, ``score`` and ``probabilities``.

    Learns from non-null texts and languages outside the held-out fold (crc32 of the id as
    text, modulo 3, is 1). A prediction reads the text alone; ``score`` is the language's
    pooled probability. A text that is null or has no letter is ``und`` with score 0; so is
    every text if nothing can be learned. A null id is not held out. Ties go to the language
    that sorts first. Repeated rows get equal results; other columns are not read.
    """
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    weights, languages = learn(training_sample(docs, id_col, text_col, lang_col))
    shared = spark.sparkContext.broadcast({"weights": weights, "languages": languages, "cache": {}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        model = Identifier(state["weights"], state["languages"], state["cache"])
        for batch in batches:
            for part in small_batches(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                told = [bool(model.languages and LETTER.search(t)) for t in texts]
                p = model.probabilities(texts) if model.languages else np.zeros((len(texts), 1))
                best = p.argmax(axis=1)
                names = [model.languages[b] if k else "und" for b, k in zip(best, told, strict=True)]
                score = np.where(told, p.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(score)],
                    names=["_id", "_lang", "_score"],
                )

    rows = docs.select(named(id_col).alias("_id"), named(text_col).alias("_text"))
    fields = [
        T.StructField("_id", rows.schema[0].dataType),
        T.StructField("_lang", T.StringType()),
        T.StructField("_score", T.DoubleType()),
    ]
    fold = F.crc32(F.col("_id").cast("string")) % 3
    return rows.mapInArrow(run, T.StructType(fields)).select(
        F.col("_id").alias(id_col),
        F.coalesce(fold == 1, F.lit(False)).alias("held_out"),
        F.col("_lang").alias("lang_pred"),
        F.col("_score").alias("score"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
