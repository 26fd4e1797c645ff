from __future__ import annotations

import base64
import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from edges import TEXTS, edge_docs, no_docs
from tokenizers import Tokenizer

from conftest import FOLDER
from turnlake.llm import bpe_encode, token_counts

MULTI = P.path("byte_bpe_multi_50k.tiktoken")
PLAIN = P.path("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(5)
    texts = [
        "", "a", " ", "  x", "it's we're 're 'r' ''s", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>",
        "ab" * 3000, "=-" * 500 + "é" * 99, "\x1c\x85 \xa0\t\n\n x", "日本語テキスト 🎉🎉", "\n\n\n",
        " \n \n a", "x" * 5000, "1234567890" * 20, "²³ ½x ªº µ",
    ]
    texts += ["".join(rng.choice("ab '\n\tst1é<|>ñ. rev🎉x²") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return texts + [t or "" for _, t, _, _ in TEXTS]


def documents():
    return [t or "" for (t,) in duckdb.sql(f"SELECT text FROM '{FOLDER}/documents.parquet'").fetchall()]


@pytest.fixture(scope="module")
def library():
    with open(MULTI, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_library_s(library):
    encoder = bpe_encode.Encoder(bpe_encode.vocabulary(MULTI), P.PATTERN)
    texts = odd_texts() + documents()
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert encoder.decode(ids.tolist()) == text.encode()


def test_cache_limits_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe_encode, "CACHE_PIECES", 50)
    monkeypatch.setattr(bpe_encode, "BATCH_CHARS", 300)
    monkeypatch.setattr(bpe_encode, "BATCH_LEAVES", 64)
    encoder = bpe_encode.Encoder(bpe_encode.vocabulary(MULTI), P.PATTERN)
    texts = odd_texts()
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)


def test_pieces_of_any_length_merge_alike(library):
    ranks = bpe_encode.Ranks(bpe_encode.vocabulary(MULTI))
    rng = random.Random(1)
    pieces = ["".join(rng.choice("abcdeéz") for _ in range(n)).encode() for n in [*range(1, 70), 300, 2000]]
    for piece, ids in zip(pieces, bpe_encode.merge_pieces(ranks, pieces), strict=True):
        assert ids == library.encode_ordinary(piece.decode())


def test_query_digests(spark, library):
    import turnlake.llm.catalog as catalog

    rows = catalog.QUERIES["op10_byte_bpe"](spark, FOLDER).collect()
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall())
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_encode_edges(spark, library):
    rows = bpe_encode.decode(bpe_encode.encode(edge_docs(spark), MULTI, P.PATTERN), MULTI).collect()
    want = sorted((str(i), library.encode_ordinary(t or "")) for i, t, _, _ in TEXTS)
    assert sorted((str(r.doc_id), r.ids) for r in rows) == want
    assert sorted(bytes(r.decoded) for r in rows) == sorted((t or "").encode() for _, t, _, _ in TEXTS)
    assert bpe_encode.encode(no_docs(spark), MULTI, P.PATTERN).count() == 0


def test_counts_are_the_library_s():
    counter = token_counts.PrefixCounter(token_counts.vocabulary(PLAIN))
    texts = odd_texts() + documents()
    library = Tokenizer.from_file(PLAIN).encode_batch(texts, add_special_tokens=False)
    assert [counter.total(t) for t in texts] == [len(e.ids) for e in library]


def test_every_prefix_is_counted_as_a_text_of_its_own():
    counter = token_counts.PrefixCounter(token_counts.vocabulary(PLAIN))
    library = Tokenizer.from_file(PLAIN)
    for text in [t for t in odd_texts() if len(t) < 300][:120]:
        cuts = [text[:k] for k in range(len(text) + 1)]
        want = [len(e.ids) for e in library.encode_batch(cuts, add_special_tokens=False)]
        counts = counter.prefixes(text)
        assert counts.tolist() == want
        for budget in (0, 1, 5, 20):
            cut = token_counts.cut_for_budget(counts, budget)
            assert want[cut] <= budget and all(w > budget for w in want[cut + 1 :])
        assert token_counts.truncated_count(counts, 3) == want[min(3, len(text))]


def test_count_edges(spark):
    library = Tokenizer.from_file(PLAIN)
    rows = token_counts.token_counts(edge_docs(spark), PLAIN, 512).collect()
    want = sorted(
        (str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512)
        for i, t, _, _ in TEXTS
    )
    assert sorted((str(r[0]), *r[1:]) for r in rows) == want
    assert token_counts.token_counts(no_docs(spark), PLAIN, 512).count() == 0
    short = edge_docs(spark).where("doc_id IN (3, 7)")
    counts = token_counts.prefix_counts(short, PLAIN).collect()
    assert sorted(len(r.counts) for r in counts) == [1, 4, 4, 49]
    assert all(np.diff([0, *r.counts]).max() <= 2 for r in counts)
