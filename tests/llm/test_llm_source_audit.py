from __future__ import annotations

import re
import string
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from edges import edge_docs, no_docs

from turnlake.llm import source_audit

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_force(rows, min_docs):
    """Rows of the audit from (text, lang, source), by Python's own integers."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = Counter()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def chances(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p, q = {s: chances(counts[lang, s]) for s in sources}, chances(whole)
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(apart(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            own = [t for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            terms = [(t, apart(p[s][t], q[t])) for t in own]
            for part, items, most in (("pair", pairs, None), ("term", terms, 10)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                for rank, (item, value) in enumerate(items[:most], 1):
                    out[lang, s, part, item, value, rank] += 1
    return out


def told(df):
    return Counter(map(tuple, df.collect()))


def made_docs(spark):
    rng = np.random.default_rng(4)
    words = [f"w{chr(97 + i % 26)}{'é' * (i % 3)}{chr(97 + i // 26)}" for i in range(60)]
    rows = []
    for i in range(300):
        lang = ["en", "fr", None, ""][i % 4]
        source = f"s{i % 9}" if i % 3 else "hot"  # a third of all rows
        n = int(rng.integers(0, 30))
        text = " ".join(rng.choice(words, n, p=np.arange(1, 61) / 1830)).upper() + " 12-x_y"
        rows.append((text if i % 17 else None, lang, source if i % 23 else None))
    return rows, spark.createDataFrame(rows, "text string, lang string, source string")


@pytest.mark.parametrize("terms, sources", [(4096, 256), (7, 256), (4096, 2), (7, 3)])
def test_like_brute_force(spark, monkeypatch, terms, sources):
    monkeypatch.setattr(source_audit, "SHARD_TERMS", terms)
    monkeypatch.setattr(source_audit, "SHARD_SOURCES", sources)
    rows, docs = made_docs(spark)
    for min_docs in (1, 10):
        assert told(source_audit.divergence_audit(docs, min_docs=min_docs)) == brute_force(rows, min_docs)


@pytest.mark.parametrize("min_docs", [1, 10])
def test_edges(spark, min_docs):
    docs = edge_docs(spark)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert told(source_audit.divergence_audit(docs, min_docs=min_docs)) == brute_force(rows, min_docs)
    assert source_audit.divergence_audit(no_docs(spark)).count() == 0


@pytest.mark.parametrize("held, chunk", [(200_000, 1 << 20), (5, 30), (40, 1)])
def test_partial_counts_combine(spark, monkeypatch, held, chunk):
    monkeypatch.setattr(source_audit, "HELD_ROWS", held)
    monkeypatch.setattr(source_audit, "CHUNK_BYTES", chunk)
    rows, _ = made_docs(spark)
    filled = [tuple(x or "" for x in r) for r in rows]
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array(c) for c in zip(*filled[at : at + 70])], names=["_text", "_lang", "_source"]
        )
        for at in range(0, len(filled), 70)
    ]
    counts, docs = Counter(), Counter()
    for batch in source_audit.partial_counts(iter(batches)):
        for r in batch.to_pylist():
            key = r["_lang"], r["_source"], r["_term"]
            counts[key] += r["_n"]
            docs[key] += r["_docs"]
    want, in_docs = Counter(), Counter()
    for text, lang, source in filled:
        terms = TERM.findall(text.translate(LOWER))
        want.update((lang, source, t) for t in terms)
        in_docs.update((lang, source, t) for t in set(terms))
    assert counts == want and docs == in_docs


def test_large_counts_do_not_overflow():
    counts = np.array([0, 5, 4 * 10**14, 10**15], np.int64)
    total = np.array([10**15 + 3] * 4, np.int64)
    want = [1 + 10**9 * (int(c) + 2) // int(t) for c, t in zip(counts, total)]
    assert source_audit.probabilities(counts, total).tolist() == want
    p, q = np.array([10**9 + 1]), np.array([1])
    assert source_audit.divergence(p, q).tolist() == [10**18 // (10**9 + 2)]
