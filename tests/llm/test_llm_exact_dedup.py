from __future__ import annotations

import hashlib
import string
from collections import Counter, defaultdict

import pytest
from edges import edge_docs, no_docs, plan

from conftest import FOLDER
from turnlake.llm import exact_dedup
from turnlake.llm.store import written

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_force(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        left = 1
        for i in sorted(ids, key=lambda i: (i is None, i)):
            kept = i == keep and left > 0
            left -= kept
            out[i, keep, len(ids), kept, sha] += 1
    return out


def told(df):
    return Counter(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))


@pytest.mark.parametrize("heavy", [1, 3, 256])
def test_like_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(exact_dedup, "HEAVY", heavy)
    rows = [(i, f"Text {'A' if i % 3 else i % 7} x") for i in range(200)] + [(5, "dup"), (5, "DUP")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(exact_dedup.exact_duplicates(docs)) == brute_force(rows)


def test_edges(spark):
    docs = edge_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert told(exact_dedup.exact_duplicates(docs)) == brute_force(rows)
    assert exact_dedup.exact_duplicates(no_docs(spark)).count() == 0


def test_rows_that_stay_keep_their_columns(spark):
    docs = edge_docs(spark)
    kept = exact_dedup.keep_one(docs)
    assert kept.schema == docs.schema
    assert kept.exceptAll(docs).isEmpty()
    want = Counter((i, s) for (i, _, _, k, s), n in brute_force([(r.doc_id, r.text) for r in docs.collect()]).items() if k)
    got = Counter((r.doc_id, hashlib.sha256((r.text or "").translate(LOWER).encode()).hexdigest()) for r in kept.collect())
    assert got == want
    assert exact_dedup.keep_one(no_docs(spark)).count() == 0


def test_native(spark):
    for build in (exact_dedup.exact_duplicates, exact_dedup.keep_one):
        shown = plan(build(spark.read.parquet(f"{FOLDER}/documents.parquet")))
        assert "Python" not in shown and "Arrow" not in shown and "CartesianProduct" not in shown


def test_winners_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HEAVY", 4)
    digests = written(spark.range(500).selectExpr("id AS _id", "unhex(sha2(CAST(id % 50 AS STRING), 256)) AS _digest"), "t")
    assert 0 < exact_dedup.heavy_winners(digests).count() <= 4
