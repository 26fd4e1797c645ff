"""Operators that learn: toxicity, language, quality. Held-out accuracy and brute force."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pytest
from edges import edge_docs, no_docs
from pyspark.sql import functions as F

from turnlake.llm import language_id, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def edge_labels(spark):
    rows = [(1, 1, 0), (1, 0, 1), (2, 1, 0), (3, None, None), (None, 1, 1), (9, 0, 1), (9, 0, 1), (10, 1, 7)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


# Toxicity


@pytest.fixture(scope="module")
def scored(docs, labels):
    return {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}


def test_toxicity_on_held_out_rows(scored, labels):
    rows = [(scored[r.doc_id], r.toxic) for r in labels.collect()]
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) for r in scored.values())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored.values())
    held = [(r.score, t) for r, t in rows if r.held_out]
    toxic, clean = ([s for s, t in held if t == k] for k in (1, 0))
    auc = np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean])
    assert auc > 0.8 and np.mean([s >= 0.5 for s in clean]) < 0.1


def test_toxicity_reads_the_text_alone(docs, labels, scored):
    changed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "n_chars": F.lit(1)})
    outside = labels.withColumn(
        "toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    again = toxicity.toxicity(changed.repartition(5), outside).collect()
    assert all(r.score == pytest.approx(scored[r.doc_id].score, abs=1e-6) for r in again)


def test_toxicity_edges(spark):
    docs, labels = edge_docs(spark), edge_labels(spark)
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({round(r.score, 12) for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert toxicity.toxicity(no_docs(spark), labels).count() == 0
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == docs.count() and not any(r.predicted for r in none)
    kept = toxicity.clean_documents(docs, labels.limit(0))
    assert kept.schema == docs.schema and kept.count() == docs.count()


def test_kneser_ney_like_brute_force(spark):
    """Probabilities of words from plain dictionaries, by the definition."""
    clean = ["aba abc abc abd", "abc abd aba zz", "abc aba"] * 3
    toxic = ["bad bad bat abc", "bad bat bad"] * 3
    rows = [(t, k) for k, texts in ((0, clean), (2, toxic)) for t in texts]
    training = spark.createDataFrame(rows, "_text string, _kind int")
    model = toxicity.Models(toxicity.model_tables(training, training))
    words = sorted({w for t, _ in rows for w in t.split()} | {"new", "babad"})

    def byte_grams(word, n):
        s = f" {word} "
        return [s[i - n + 1 : i + 1] for i in range(1, len(s)) if i >= n - 1]

    grams = {n: {g for t, _ in rows for w in t.split() for g in byte_grams(w, n)} for n in range(2, toxicity.ORDER + 2)}

    def shared(text, n):
        """p(last byte | the n - 1 before it) from continuation counts."""
        if n == 0:
            return 1 / 256
        below = shared(text, n - 1)
        seen = {}
        for g in grams[n + 1]:
            if g[1:-1] == text[len(text) - n : -1]:
                seen[g[1:]] = seen.get(g[1:], 0) + 1
        total = sum(seen.values())
        if not total:
            return below
        own = max(seen.get(text[len(text) - n :], 0) - toxicity.DISCOUNT, 0)
        return (own + toxicity.DISCOUNT * len(seen) * below) / total

    def log_p(word, kind):
        s, out = f" {word} ", 0.0
        counts = {}
        for t, k in rows:
            if k == kind:
                for w in t.split():
                    for i in range(1, len(w) + 2):
                        counts[f" {w} "[: i + 1]] = counts.get(f" {w} "[: i + 1], 0) + 1
        for i in range(1, len(s)):
            p = shared(s[: i + 1], min(i, toxicity.ORDER))
            after = [c for g, c in counts.items() if len(g) == i + 1 and g.startswith(s[:i])]
            if after:
                d = toxicity.CLASS_DISCOUNT
                own = max(counts.get(s[: i + 1], 0) - d, 0)
                p = (own + sum(min(c, d) for c in after) * p) / sum(after)
            out += math.log(p + 1e-12)
        return out

    want = [log_p(w, 2) - log_p(w, 0) for w in words]
    assert model.ratios(words) == pytest.approx(want, abs=1e-6)


def test_toxic_passages_begin_at_any_word():
    models = toxicity.Models({name: (np.zeros(0, np.int64), np.zeros((11, 0))) for name in toxicity.TABLES})
    rng = np.random.default_rng(3)
    ratio, size = rng.normal(2, 1, 16), rng.integers(2, 9, 16) + 1.0
    alone = models._features(ratio, size)[: len(toxicity.PASSAGES)]
    for n in range(1, 16):
        words = np.concatenate([np.full(n, -3.0), ratio]), np.concatenate([np.full(n, 5.0), size])
        shifted = models._features(*words)[: len(toxicity.PASSAGES)]
        assert all(b >= a - 1e-9 for a, b in zip(alone, shifted, strict=True))
    for length in (1, 3, 7, 16, 50):
        ratio, size = rng.normal(0, 1, length), rng.integers(2, 9, length) + 1.0
        for n, got in zip(toxicity.PASSAGES, models._features(ratio, size), strict=False):
            n = min(n, length)
            spans = [slice(i, i + n) for i in range(length - n + 1)]
            want = max(ratio[s].sum() / (size[s].sum() + toxicity.LENGTH_PRIOR) for s in spans)
            assert got == pytest.approx(want, abs=1e-9)


def test_toxicity_looks_bins_up_in_one_step_and_halves_share_the_tables():
    rng = np.random.default_rng(4)
    bins = np.sort(rng.choice(toxicity.BINS, 500, replace=False)).astype(np.int32)
    bins[0], bins[-1] = 0, toxicity.BINS - 1
    values = rng.integers(1, 9, (3, 500)).astype(np.float32)
    known = dict(zip(bins.tolist(), values.T.tolist(), strict=True))
    wanted = np.concatenate([rng.choice(bins, 300), rng.integers(0, toxicity.BINS, 300), bins[[0, -1]]])
    got = toxicity.Table((bins, values)).at(wanted.astype(np.int64))
    assert got.dtype == np.float64 and got.T.tolist() == [known.get(b, [0.0] * 3) for b in wanted.tolist()]
    models = toxicity.Models({name: (bins, np.ones((11, 500), np.float32)) for name in toxicity.TABLES})
    halves = [models.of_half(1), models.of_half(0)]
    assert [m.half for m in (models, *halves)] == [None, 1, 0]
    assert all(m.tables is models.tables and m.words is not models.words for m in halves)


@pytest.mark.parametrize("told", [[], [3], [1, 4, 9], list(range(-5, 12))])
def test_toxicity_tells_each_gram_once(told):
    told = np.array(told, np.int64)
    for keys in ([], [4], [9, 9, 4, 2, 2, 30, -1, 0]):
        keys = np.array(keys, np.int64)
        assert toxicity.unread(keys, told).tolist() == np.setdiff1d(keys, told).tolist()


# Language


def test_language_on_held_out_rows(docs):
    found = {r.doc_id: r for r in language_id.languages_of(docs).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    assert all(found[r.doc_id].held_out == (fold(r.doc_id, 3) == 1) for r in rows)
    held = [r for r in rows if found[r.doc_id].held_out and r.lang and re.search(r"[^\W\d_]", r.text or "")]
    assert np.mean([found[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_edges(spark):
    docs = edge_docs(spark)
    rows = language_id.languages_of(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert {r.lang_pred for r in rows} <= {"en", "fr", "es", "de", "und"}
    signs = docs.limit(1).withColumn("text", F.lit("12 ² ½ _ !")).unionByName(docs)
    assert language_id.languages_of(signs.withColumn("doc_id", F.lit(8))).where("lang_pred = 'und'").count() == 4
    assert language_id.languages_of(no_docs(spark)).count() == 0
    unknown = language_id.languages_of(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unknown} == {"und"}


def test_gradients_through_time():
    w = {k: v.astype(np.float64) for k, v in language_id.new_weights(3, np.random.default_rng(0)).items()}
    codes, mask = language_id.padded([b"abc", b"hello", b"x"])
    label, mask = np.array([0, 2, 1]), mask.astype(np.float64)

    def loss():
        logs = language_id.position_logs(w, codes, mask)
        return -(logs[:, np.arange(3), label] * mask).sum() / mask.sum()

    g = language_id.gradients(w, codes, mask, label)
    rng = np.random.default_rng(1)
    for k in w:
        at = tuple(int(rng.integers(0, n)) for n in w[k].shape)
        at = (ord("l"), at[1]) if k == "embed" else at
        kept, step = w[k][at], 1e-3
        w[k][at] = kept + step
        up = loss()
        w[k][at] = kept - step
        down = loss()
        w[k][at] = kept
        assert (up - down) / (2 * step) == pytest.approx(g[k][at], abs=2e-5)


# Quality


def test_weights_like_brute_force(spark, docs, labels, monkeypatch):
    monkeypatch.setattr(quality, "BUCKETS", 997)
    some = docs.where("doc_id < 150")
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    rows = {r.doc_id: r for r in quality.resampled(some, labels).collect()}
    texts = {r.doc_id: r.text or "" for r in some.collect()}

    def words(text):
        return re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text))

    # The hash is the operator's own; counting and ratios are done again here.
    import pyarrow as pa

    buckets = {}
    for doc_id, text in texts.items():
        ((_, found),) = quality.bucket_counts(pa.array([text]))
        n = len(words(text))
        assert len(found) == max(0, 2 * n - 1)
        buckets[doc_id] = np.bincount(found, minlength=997)
    raw = 1 + sum(buckets.values())
    target = 1 + sum(buckets[i] for i in texts if i in good)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for doc_id, r in rows.items():
        assert r.log_weight == pytest.approx(float(buckets[doc_id] @ ratio), abs=1e-6)
        assert r.n_grams == buckets[doc_id].sum()
    keys = sorted((r.sample_key for r in rows.values()), reverse=True)
    bar = keys[math.ceil(0.5 * len(rows)) - 1]
    assert all(r.selected == (r.sample_key >= bar) for r in rows.values())


def test_quality_tells_junk(docs, labels):
    rows = {r.doc_id: r for r in quality.resampled(docs, labels).collect()}
    known = [(rows[r.doc_id].score, r.quality) for r in labels.collect()]
    good, junk = ([s for s, q in known if q == k] for k in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in junk]) > 0.9


@pytest.mark.parametrize("cuts", [2, 4096])
def test_kth_largest(spark, monkeypatch, cuts):
    monkeypatch.setattr(quality, "CUTS", cuts)
    values = [math.sin(i) * 10 ** (i % 7) for i in range(300)] + [5.0] * 20 + [1.0, 1.0 + 2**-52]
    keys = spark.createDataFrame([(v,) for v in values], "_key double")
    for k in (1, 17, 150, len(values)):
        assert quality.kth_largest(keys, k) == sorted(values, reverse=True)[k - 1]


def test_gumbel_is_standard(spark):
    found = spark.range(20_000).select(quality.gumbel(F.col("id")).alias("g")).agg(F.avg("g"), F.stddev("g")).first()
    assert found[0] == pytest.approx(0.5772, abs=0.03) and found[1] == pytest.approx(1.2825, abs=0.04)


def test_quality_edges(spark):
    docs, labels = edge_docs(spark), edge_labels(spark)
    rows = quality.resampled(docs, labels).collect()
    assert len(rows) == docs.count() and sum(r.selected for r in rows) >= math.ceil(len(rows) / 2)
    assert all(r.log_weight == 0 and r.score == 0.5 for r in rows if r.doc_id in (3, 4, 5))
    assert quality.resampled(no_docs(spark), labels).count() == 0
    assert not any(r.selected for r in quality.resampled(docs, labels, keep=0.0).collect())
