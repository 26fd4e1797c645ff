from __future__ import annotations

import re
import string
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from turnlake.llm import bpe_encode, mixing, toxicity
from turnlake.llm.store import written

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORDS = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input rows, output rows) of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, SF), name)
        out.append((name, before, docs))
    return out


def test_order_and_columns(stages):
    assert [name for name, *_ in stages] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "mix_sources", "byte_bpe"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_toxic_documents_go(spark, stages):
    _, before, after = stages[0]
    scores = toxicity.toxicity(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scores if not r.predicted}


def test_one_of_equal_texts_stays(stages):
    _, before, after = stages[1]
    last = {}
    for r in before.collect():
        key = (r.text or "").translate(LOWER)
        last[key] = max(last.get(key, -1), r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(last.values())


def test_one_of_near_copies_stays(stages):
    _, before, after = stages[2]
    rows, sets = [(r.doc_id, r.text) for r in before.collect()], []
    for _, text in rows:
        w = WORDS.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, _) in enumerate(rows):
        for y in range(x):
            a, b = sets[x], sets[y]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((find(i), find(rows[y][0])))
                root[high] = low
    assert sorted(r.doc_id for r in after.collect()) == sorted({find(i) for i, _ in rows})


def test_mix_holds_the_words_taken(stages):
    _, before, after = stages[3]
    taken = Counter()
    for r in after.collect():
        taken[r.doc_id] += len(WORDS.findall(r.text))
    want = {r.doc_id: r.taken for r in mixing.taken_words(before).collect() if r.taken}
    assert taken == want


def test_ids_are_the_library_s_and_decode(stages):
    _, before, after = stages[4]
    ranks = bpe_encode.vocabulary(P.path(corpus_pipeline.TOKENIZER))["ids"]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = defaultdict(list)
    for r in before.collect():
        texts[r.doc_id].append(r.text)
    got = defaultdict(list)
    for r in after.collect():
        got[r.doc_id].append(r.text)
        assert r.ids == library.encode_ordinary(r.text) and r.n_tokens == len(r.ids)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}


def test_registered():
    queries = entry.queries()
    assert "pipeline" in queries and corpus_pipeline.ORACLE_SQL is None
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in queries) == 1
    assert set(entry.oracle_sql()) <= set(queries)


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
