from __future__ import annotations

import struct
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from edges import edge_docs, no_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import FOLDER
from turnlake.llm import mixed_packing as packing

PATH = P.path("word_bpe_49k.json")


@cache
def tokenizer(path=PATH):
    return Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def library():
    return tokenizer()


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def check_whole(library, docs, pieces, length):
    """Every id of every document is in one piece, and sequences have neither gaps nor padding."""
    sequences, copies = defaultdict(list), Counter()
    by_doc = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        by_doc[p.doc_id, p.source, p.doc_tokens].append(p)
    want = Counter()
    for d in docs:
        ids = ids_of(library, d.text)
        for at, token in enumerate(ids):
            want[d.doc_id, d.source, len(ids), at, token] += 1
    for key, parts in by_doc.items():
        for p in parts:
            assert p.length * 4 == len(p.ids)
            for at, token in enumerate(struct.unpack(f"<{p.length}I", p.ids), p.start):
                copies[*key, at, token] += 1
    assert copies == want
    sizes = {}
    for s, parts in sequences.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        sizes[s] = at
    assert sorted(sizes) == list(range(len(sizes)))
    full = sum(sizes.values()) // length
    assert all(sizes[s] == length for s in range(full))
    tail = [sizes[s] for s in range(full, len(sizes))]
    assert all(n & (n - 1) == 0 for n in tail) and tail == sorted(set(tail), reverse=True)


@pytest.mark.parametrize("length, chunk", [(2048, 1 << 21), (128, 5000), (100, 777), (64, 64)])
def test_whole_tables(spark, library, length, chunk):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(3)
    pieces = packing.packed_pieces(docs, PATH, length=length, chunk_tokens=chunk).collect()
    check_whole(library, docs.collect(), pieces, length)


@pytest.mark.parametrize("targets", [None, {"s1": 0.5, None: 0.25}, {"s1": 2.0, "absent": 1.0}])
def test_edges(spark, library, targets):
    docs = edge_docs(spark)
    pieces = packing.packed_pieces(docs, PATH, targets=targets, length=256, chunk_tokens=3000)
    check_whole(library, docs.collect(), pieces.collect(), 256)
    assert packing.packed_pieces(no_docs(spark), PATH, targets=targets).count() == 0


def shares(pieces):
    out = defaultdict(Counter)
    for p in pieces:
        out[p.sequence_id][p.source] += p.length
    return out


def test_each_sequence_has_the_targets(spark):
    """A hot source, small ones, and one of a few tokens, over many chunks."""
    rows = [(i, " ".join(["word cat dog"] * (i % 40)), "hot" if i % 3 else f"s{i % 8}") for i in range(2000)]
    rows.append((9999, "tiny text", "tiny"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    pieces = packing.packed_pieces(docs, PATH, length=1024, chunk_tokens=10_000).collect()
    got, total = shares(pieces), Counter()
    for counts in got.values():
        total.update(counts)
    tokens = sum(total.values())
    for s in range(tokens // 1024):
        for source, n in total.items():
            assert abs(got[s][source] - 1024 * n / tokens) < 6 * packing.LEAST, (s, source)
    running = Counter()
    for s in range(tokens // 1024):  # deficits are carried, so the error does not add up
        running.update(got[s])
        for source, n in total.items():
            assert abs(running[source] - (s + 1) * 1024 * n / tokens) < 6 * packing.LEAST


def test_given_targets_until_a_source_runs_dry(spark):
    rows = [(i, "alpha beta gamma delta " * 20, f"s{i % 4}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.packed_pieces(docs, PATH, targets={"s0": 0.5, "s1": 0.2}, length=512, chunk_tokens=6000)
    got = shares(pieces.collect())
    for s in range(20):
        assert abs(got[s]["s0"] - 256) < 80 and abs(got[s]["s1"] - 102) < 80
    last = max(got) - 8
    assert not got[last]["s0"] and not got[last]["s1"] and abs(got[last]["s2"] - 256) < 80


def test_sequences_put_pieces_together(spark, library):
    docs = edge_docs(spark)
    pieces = packing.packed_pieces(docs, PATH, length=512, chunk_tokens=2000)
    rows = packing.sequences(pieces).collect()
    assert sum(r.n_tokens for r in rows) == sum(len(ids_of(library, d.text)) for d in docs.collect())
    for r in rows:
        assert len(r.ids) == 4 * r.n_tokens == 4 * sum(p.length for p in r.parts)
        assert [p.offset for p in r.parts] == list(np.cumsum([0] + [p.length for p in r.parts])[:-1])


HARD = [
    "Café CAFÉ café ̈x   a b c \x1c d\x85e",
    "it's I'LL we've 'd x'S <|endoftext|> a<|startoftext|>b < | endoftext|>",
    "İstanbul ΣΑΣ ß ﬁ ǅ 日本語 テスト🎉🎉 ๑๒ ½ ²",
    "\n\t a\r\nb\x0b\x0cc  ",
    "",
    "x" * 500 + " " + "ab1!" * 100,
    "'s 'd ''s !'s a'sb c'll'd 'rex 'lx 'vE x'",
    "'",
    "".join(map(chr, range(256))),
    "'S".join(map(chr, range(33, 256))),
]


def test_ids_are_the_library_s(spark, library):
    texts = [r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    for part in (HARD, texts):
        ids, sizes = packing.WordIds(PATH).encode(pa.array(part))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [ids_of(library, t) for t in part]


@given(st.lists(st.text(st.sampled_from("aB é́ \n'sD<|>endoftxt1٣!\x1cΣİ"), max_size=30), min_size=1, max_size=5))
@settings(max_examples=80, deadline=None)
def test_ids_of_any_text(texts):
    words, library = packing.encoder(PATH), tokenizer()
    ids, sizes = words.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [ids_of(library, t) for t in texts]


def test_long_texts_are_cut_in_stretches(monkeypatch, library):
    monkeypatch.setattr(packing, "STRETCH", 7)
    text = "alpha beta's gamma  delta\n\nepsilonzeta 'll eta 日本 theta"
    ids, sizes = packing.WordIds(PATH).encode(pa.array([text, "", text]))
    want = ids_of(library, text)
    assert ids.tolist() == want + [packing.END_ID] + want and sizes.tolist() == [len(want), 1, len(want)]


def test_ids_of_another_tokenizer():
    path = P.path("byte_bpe_50k.json")
    words, library = packing.WordIds(path), tokenizer(path)
    ids, sizes = words.encode(pa.array(HARD))
    assert not words.by_piece
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [ids_of(library, t) for t in HARD]


def test_words_are_forgotten_beyond_a_number(monkeypatch, library):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    words = packing.WordIds(PATH)
    for text in ("one two three four five", "one six", "one two six"):
        ids, _ = words.encode(pa.array([text]))
        assert ids.tolist() == ids_of(library, text)


@given(
    st.lists(st.integers(1, 900), min_size=1, max_size=12),
    st.integers(1, 300),
    st.integers(1, 40),
    st.integers(0, 10**6),
)
@settings(max_examples=80, deadline=None)
def test_fill_uses_every_budget(budgets, room, least, seed):
    budgets = np.array(budgets, np.int64)
    total = int(budgets.sum())
    capacities = np.diff(np.append(np.arange(0, total, room), total))
    carry = np.random.default_rng(seed).random(len(budgets)) * least
    window, source, taken = packing.fill(budgets, carry, capacities, least)
    assert (np.bincount(source, taken, len(budgets)) == budgets).all()
    assert (np.bincount(window, taken, len(capacities)) == capacities).all()


def test_sequence_bounds_agree_over_chunks():
    for total in (0, 1, 63, 64, 200, 1000):
        whole = packing.sequence_bounds(0, total, total, 64)
        assert whole[0][-1:].tolist() in ([total], [])
        known = dict(zip(whole[1].tolist(), zip(whole[0], whole[0][1:])))
        for low in range(0, total, 37):
            places, numbers = packing.sequence_bounds(low, min(total, low + 37), total, 64)
            for k, number in enumerate(numbers.tolist()):
                assert known[number] == (places[k], places[k + 1])
            assert places[0] <= low and places[-1] >= min(total, low + 37)
