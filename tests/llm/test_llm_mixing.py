from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from edges import edge_docs, no_docs, plan

from conftest import FOLDER
from turnlake.llm import mixing

WORDS = re.compile("[^\x20\x09-\x0d]+")


def size(text):
    return len(WORDS.findall(text or ""))


def targets(sizes):
    """The rule itself: share by weight, cap, share the excess by weight until none is above."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = total - sum(3 * sizes[n] for n in capped)
        open_weight = sum(weight[n] for n in names if n not in capped)
        want = {n: 3 * sizes[n] if n in capped else free * weight[n] / open_weight for n in names}
        above = {n for n in names if n not in capped and want[n] > 3 * sizes[n] + 1e-9}
        if not above:
            return want
        capped |= above


def test_shares(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    rows = mixing.taken_words(docs).collect()
    again = mixing.taken_words(docs.repartition(7)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    sizes = defaultdict(int)
    for r in texts.values():
        sizes[r.source] += size(r.text)
    want, got = targets(sizes), defaultdict(int)
    for r in rows:
        source = texts[r.doc_id].source
        assert r.size == size(texts[r.doc_id].text) and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source]) and r.taken <= 3 * r.size
        got[source] += r.taken
    for source, target in want.items():
        assert abs(got[source] - target) <= 1
    assert len(rows) == len(texts)


def test_caps_and_a_hot_source(spark):
    rows = [(i, "w " * 300, "hot") for i in range(60)] + [(100, "v " * 50, "tiny"), (101, "", "blank"), (102, "u " * 400, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {"hot": 18000, "tiny": 50, "blank": 0, None: 400}
    want = targets(sizes)
    got = defaultdict(int)
    source = {i: s for i, _, s in rows}
    for r in mixing.taken_words(docs).collect():
        assert r.target == pytest.approx(want[source[r.doc_id]])
        got[source[r.doc_id]] += r.taken
    assert got["tiny"] == 150 and got["blank"] == 0 and got[None] == 1200
    assert abs(got["hot"] - want["hot"]) < 3 * mixing.BLOCK_WORDS


def test_permutations_visit_every_block_once(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 10, 997):
        rows = spark.range(n).select(
            mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit(1).cast("long")).alias("p")
        )
        assert sorted(r.p for r in rows.collect()) == list(range(n))


def test_permutations_of_very_many_blocks(spark):
    from pyspark.sql import functions as F

    n = 2 * 10**10
    rows = spark.range(n - 2000, n).select(
        mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit(1).cast("long")).alias("p")
    )
    got = [r.p for r in rows.collect()]
    assert len(set(got)) == 2000 and all(0 <= p < n for p in got)


@pytest.mark.parametrize("shard_slots", [16, 100, 8192])
def test_many_small_sources_meet_their_targets_over_shards(spark, monkeypatch, shard_slots):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", shard_slots)
    rows = [(i, "w " * (i % 7 * 40 + 3), f"s{i % 211}") for i in range(800)]
    rows += [(10_000 + i, "h " * 500, "hot") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes, got = defaultdict(int), defaultdict(int)
    source = {i: s for i, _, s in rows}
    for i, text, s in rows:
        sizes[s] += size(text)
    for r in mixing.taken_words(docs).collect():
        assert r.taken <= 3 * r.size
        got[source[r.doc_id]] += r.taken
    assert all(abs(got[s] - t) <= 1 for s, t in targets(sizes).items())


def test_shards_hold_about_their_share(spark, monkeypatch):
    """Slots against a replay: each is given once, and shards are near the sources' shares."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 64)
    rows = [(s, 100 + 37 * s) for s in range(40)]
    total = sum(n for _, n in rows)
    sources = spark.createDataFrame(rows, "_s int, _slots long")
    got, shards = defaultdict(list), Counter()
    for r in mixing.drawn_slots(sources).collect():
        got[r._s] += range(r._first, r._first + r._count)
        shards[r._shard, r._s] += r._count
    assert {s: sorted(x) for s, x in got.items()} == {s: list(range(n)) for s, n in rows}
    last = -(-total // 64) - 1
    for (shard, s), n in shards.items():
        share = 64 * dict(rows)[s] / total
        assert shard == last or n <= int(share) + 12
    in_shard = Counter()
    for (shard, _), n in shards.items():
        in_shard[shard] += n
    assert sum(abs(in_shard[k] - 64) for k in range(last)) <= 0.05 * total


def test_edges(spark):
    docs = edge_docs(spark)
    rows = mixing.taken_words(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.taken <= 3 * r.size for r in rows)
    assert Counter(r.size for r in rows) == Counter(size(r.text) for r in docs.collect())
    assert mixing.taken_words(no_docs(spark)).count() == 0
    assert mixing.mixed_documents(no_docs(spark)).count() == 0
    blank = docs.where("doc_id IN (3, 4, 5)")
    assert [r.taken for r in mixing.taken_words(blank).collect()] == [0, 0, 0]


def test_mixed_documents_hold_the_words_taken(spark):
    for docs in (edge_docs(spark), spark.read.parquet(f"{FOLDER}/documents.parquet")):
        mixed = mixing.mixed_documents(docs)
        assert mixed.columns == docs.columns
        taken, texts = Counter(), defaultdict(list)
        for r in docs.collect():
            texts[r.doc_id].append(r.text or "")
        for r in mixed.collect():
            taken[r.doc_id] += size(r.text)
            assert any(r.text in t for t in texts[r.doc_id]) and size(r.text) > 0
        want = Counter()
        for r in mixing.taken_words(docs).collect():
            want[r.doc_id] += r.taken
        assert taken == Counter({k: v for k, v in want.items() if v})


def test_native(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for build in (mixing.taken_words, mixing.mixed_documents):
        shown = plan(build(docs))
        assert "Python" not in shown and "Arrow" not in shown and "CartesianProduct" not in shown
