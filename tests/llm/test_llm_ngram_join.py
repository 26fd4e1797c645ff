from __future__ import annotations

import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from edges import edge_docs, no_docs

from turnlake.llm import ngram_join
from turnlake.llm.components import connected
from turnlake.llm.prefix_trie import join_sets

WORDS = re.compile("[^\x20\x09-\x0d]+")


def grams(text, n):
    w = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def brute_force(rows, n, bar):
    """{row: (size, component, links)} over rows (id, text)."""
    part, whole = bar
    sets = [grams(t, n) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and whole * len(a & b) >= part * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [r[0] for k, r in enumerate(rows) if find(k) == find(i) and r[0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None), links[i]))
    return sorted(out, key=str)


def told(docs, n, bar):
    return sorted(map(tuple, ngram_join.ngram_classes(docs, n, bar).collect()), key=str)


def near_copies(seed, families=6, members=8, shared=True):
    rng = random.Random(seed)
    passage = " ".join(f"common{i}" for i in range(25))
    rows = []
    for f in range(families):
        base = [f"w{rng.randrange(2000)}" for _ in range(rng.choice([1, 3, 6, 40, 150]))]
        for _ in range(members):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text) + (f"\n{passage}" if shared and rng.random() < 0.5 else "")))
    return rows


@pytest.mark.parametrize(("n", "bar"), [(4, (85, 100)), (5, (4, 5)), (2, (1, 2))])
def test_like_brute_force(spark, n, bar):
    rows = near_copies(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(docs, n, bar) == brute_force(rows, n, bar)


def test_families_beyond_a_cell_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL_TOKENS", 300)
    monkeypatch.setattr(ngram_join, "PART_TOKENS", 50)
    rows = near_copies(9, families=2, members=30, shared=False)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(docs, 4, (85, 100)) == brute_force(rows, 4, (85, 100))


@pytest.mark.parametrize("block", [0, 1])
def test_a_cell_with_an_empty_block_has_no_pairs(block):
    tokens = np.arange(100, dtype=np.uint64).tobytes()
    names = ["_family", "_i", "_j", "_set", "_block", "_n", "_copies", "_tokens"]

    def links(i, j):
        rows = [(7, i, j, s, block, 100, 1, tokens) for s in (1, 2, 3)]
        batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])
        return [b.column(2).to_pylist() for b in ngram_join.joined_cells((85, 100))(iter([batch]))]

    assert links(block, block) == [[2, 2, 2]] and links(0, 1) == [[0, 0, 0]]


def test_edges(spark):
    docs = edge_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert told(docs, 4, (85, 100)) == brute_force(rows, 4, (85, 100))
    assert told(no_docs(spark), 4, (85, 100)) == []


def test_one_of_each_group_stays(spark):
    docs = edge_docs(spark)
    kept = ngram_join.one_per_class(docs)
    assert kept.schema == docs.schema and kept.exceptAll(docs).isEmpty()
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    # 1, 2 and a null id share a text; 7 comes with two texts; 3, 4 and 5 have no words.
    assert ids == sorted([1, 3, 4, 5, 6, 7, 7, None, 9, 10], key=str)
    assert ngram_join.one_per_class(no_docs(spark)).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_prefix_trie_like_brute_force(seed):
    rng = np.random.default_rng(seed)
    base = [rng.choice(500, rng.integers(1, 120), replace=False) for _ in range(3)]
    sets = []
    for _ in range(rng.integers(1, 25)):
        b = base[rng.integers(3)]
        k = int(len(b) * rng.choice([0, 0.03, 0.08, 0.2]))
        b = np.delete(b, rng.choice(len(b), k, replace=False))
        b = np.union1d(b, rng.choice(3000, rng.integers(0, max(1, k) + 1)))
        sets.append(np.unique(b).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    n, copies = len(sets), rng.integers(1, 4, len(sets))
    side = rng.integers(0, 2, n) if seed % 2 else np.zeros(n, int)
    bar = [(85, 100), (4, 5), (1, 1)][seed % 3]
    label, links = join_sets(sets, np.array([len(s) for s in sets]), copies, side, bar)
    root, want = list(range(n)), np.zeros(n, int)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if side.any() and side[i] == side[j]:
                continue
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if bar[1] * len(a & b) >= bar[0] * len(a | b):
                want[i] += copies[j]
                want[j] += copies[i]
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert (links == want).all() and [find(i) for i in range(n)] == label.tolist()


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(0, i) for i in range(400, 500)]
    pairs += [(600 + i, 601 + i) for i in range(40)] + [(7, 7)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}


@pytest.mark.parametrize(("sampled", "least"), [(1, 2), (1, 12), (4, 8)])
def test_frequent_tokens_change_no_link(spark, monkeypatch, sampled, least):
    monkeypatch.setattr(ngram_join, "SAMPLED", sampled)
    monkeypatch.setattr(ngram_join, "HOT_ROWS", least)
    monkeypatch.setattr(ngram_join, "PART_TOKENS", 200)
    rows = near_copies(21)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts, bar = docs.select(docs.text.alias("_text")), (85, 100)
    tokens, estimates = ngram_join.frequent_tokens(texts, 4, bar, 10**6)
    sets = {t.tobytes(): t for t in ngram_join.ngram_sets(pa.array([t for _, t in rows]), 4) if len(t)}
    df = Counter(x for t in sets.values() for x in t[: ngram_join.prefix_size(len(t), *bar)].tolist())
    assert len(tokens) and (np.diff(tokens.astype(object)) > 0).all()
    assert all(df[t] > 1 for t in tokens.tolist())
    if sampled == 1:
        assert dict(zip(tokens.tolist(), estimates.tolist(), strict=True)) == {t: k for t, k in df.items() if k >= least}
    assert told(docs, 4, bar) == brute_force(rows, 4, bar)


def test_a_token_of_all_prefixes_lies_in_many_parts():
    """Rows of one part stay few, though every class holds the same rare hashes."""
    words = " ".join(f"s{i}" for i in range(40))
    texts = pa.array([f"{words} " + " ".join(f"u{k}x{i}" for i in range(20)) for k in range(2000)])
    bar, parts = (85, 100), 16
    tokens, _ = ngram_join.class_prefixes(texts, 4, bar)
    values, counts = np.unique(tokens, return_counts=True)
    hot = values[counts >= 100], counts[counts >= 100]
    assert hot[1].max() == 2000  # in every prefix

    def rows_by_part(frequent):
        listed = SimpleNamespace(value=frequent)
        batch = pa.RecordBatch.from_arrays([texts], names=["_text"])
        (packed,) = ngram_join.packed_prefixes(4, bar, parts, listed)(iter([batch]))
        return {p: len(s.as_py()) // 8 for p, s in zip(packed[0].to_pylist(), packed[2], strict=True)}

    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    before, after = rows_by_part(none), rows_by_part(hot)
    assert sum(before.values()) == sum(after.values()) == len(tokens)
    assert max(after.values()) < max(before.values()) / 2 and len(after) > len(before)


def test_parts_are_about_equal():
    """Prefixes hold the smallest hashes of their sets, and still fill every part."""
    texts = pa.array([" ".join(f"u{k}x{i}" for i in range(60)) for k in range(2000)])
    tokens, _ = ngram_join.class_prefixes(texts, 4, (85, 100))
    counts = np.bincount(ngram_join.part_of(tokens, 16), minlength=16)
    assert len(counts) == 16 and counts.max() < 1.2 * counts.min()
