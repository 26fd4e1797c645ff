"""Byte-level BPE by a segment tree over byte positions.

The tree's leaves are the pairs (token at a position, token after it) with their rank; a node
holds the lowest rank below it, and the leftmost of equal ones. A merge takes the pair at the
root, joins the two tokens, and updates the at most three leaves whose pair changed, each along
its path to the root. So a piece of n bytes costs O(n log n), however long it is. Pieces of
like length are encoded side by side: each row of the arrays is one piece's tree.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.llm.pieces import splitter
from turnlake.llm.store import named, text_batches

# Rank of a pair that does not merge.
NEVER = np.int32(2**31 - 1)
# Pieces that a worker remembers, and ids of theirs.
CACHE_PIECES = 300_000
CACHE_IDS = 4_000_000
# Texts are encoded together up to this many characters.
BATCH_CHARS = 1 << 19
# Leaves of the trees that are worked on side by side.
BATCH_LEAVES = 1 << 18


def vocabulary(path: str) -> dict:
    """A vocabulary of lines "base64 rank" as plain data: it travels to the tasks as it is.

    ``pair_keys`` and ``pair_ranks`` hold every two tokens that together spell a third.
    """
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    tokens = [b""] * (max(ranks.values()) + 1)
    pairs = {}
    for token, rank in ranks.items():
        tokens[rank] = token
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = rank
    keys = np.array(sorted(pairs), np.int64)
    return {
        "ids": ranks,
        "tokens": tokens,
        "bytes": np.array([ranks[bytes([b])] for b in range(256)], np.int32),
        "pair_keys": keys,
        "pair_ranks": np.array([pairs[k] for k in keys.tolist()], np.int32),
        "cache": {},
    }


class Ranks:
    """The pairs of a vocabulary."""

    def __init__(self, vocab: dict):
        self.byte_ids = vocab["bytes"]
        self.pair_keys = vocab["pair_keys"]
        self.pair_ranks = vocab["pair_ranks"]

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two neighbours make, or ``NEVER``."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)


def merge_pieces(ranks: Ranks, pieces: list[bytes]) -> list[list[int]]:
    """The ids of each piece after all merges; pieces of any length, side by side."""
    out: list[list[int]] = [[]] * len(pieces)
    by_width: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        by_width.setdefault(max(1, (len(piece) - 1).bit_length()), []).append(i)
    for bits, members in by_width.items():
        step = max(1, BATCH_LEAVES >> bits)
        for at in range(0, len(members), step):
            part = members[at : at + step]
            merged = _merge_trees(ranks, [pieces[i] for i in part], 1 << bits)
            for i, ids in zip(part, merged, strict=True):
                out[i] = ids
    return out


def _merge_trees(ranks: Ranks, pieces: list[bytes], width: int) -> list[list[int]]:
    """Pieces of at most ``width`` bytes (a power of two), one tree each."""
    n = len(pieces)
    lengths = np.array([len(p) for p in pieces])
    padded = b"".join(p.ljust(width, b"\0") for p in pieces)
    token = ranks.byte_ids[np.frombuffer(padded, np.uint8)].reshape(n, width).copy()
    place = np.arange(width)
    inside = place < lengths[:, None]
    after = np.where(inside, place + 1, width)  # the next live token
    after = np.minimum(after, lengths[:, None])
    before = np.broadcast_to(place - 1, (n, width)).copy()
    alive = inside.copy()
    # tree[:, 1] is the root; the leaf of position p is node width + p. A node is the value
    # rank * width + position, so the minimum is the lowest rank, leftmost first.
    tree = np.full((n, 2 * width), np.int64(NEVER) * width + width - 1, np.int64)
    first = ranks.pair_rank(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, width - 1)
    first = np.where(place[1:] < lengths[:, None], first, NEVER).astype(np.int64)
    tree[:, width : 2 * width - 1] = first * width + place[:-1]
    low = width
    while low > 1:
        below = tree[:, low : 2 * low]
        tree[:, low // 2 : low] = np.minimum(below[:, ::2], below[:, 1::2])
        low //= 2
    rows = np.arange(n)
    never = np.int64(NEVER) * width
    while True:
        rows = rows[tree[rows, 1] < never]
        if not len(rows):
            break
        best = tree[rows, 1]
        left = best % width
        right = after[rows, left]
        beyond = after[rows, right]
        token[rows, left] = best // width
        alive[rows, right] = False
        after[rows, left] = beyond
        ends = beyond < lengths[rows]
        before[rows[ends], beyond[ends]] = left[ends]
        # The pairs that begin at the merged token, at the token that vanished, and before.
        value = np.full(len(rows), NEVER, np.int64)
        value[ends] = ranks.pair_rank(token[rows[ends], left[ends]], token[rows[ends], beyond[ends]])
        has = before[rows, left] >= 0
        previous = before[rows[has], left[has]]
        joined = ranks.pair_rank(token[rows[has], previous], token[rows[has], left[has]])
        at_row = np.concatenate([rows, rows, rows[has]])
        at = np.concatenate([left, right, previous])
        new = np.concatenate([value, np.full(len(rows), NEVER, np.int64), joined.astype(np.int64)])
        tree[at_row, width + at] = new * width + at
        node = (width + at) >> 1
        while node[0] >= 1:
            tree[at_row, node] = np.minimum(tree[at_row, 2 * node], tree[at_row, 2 * node + 1])
            node >>= 1
    counts = alive.sum(axis=1)
    ids = token[alive].tolist()
    ends = np.cumsum(counts).tolist()
    return [ids[b - c : b] for b, c in zip(ends, counts.tolist(), strict=True)]


class Pieces(dict):
    """Numbers pieces in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = number = len(self)
        return number

    def add(self, merged: list[list[int]]) -> None:
        """The ids of the pieces in ``new``."""
        lengths = np.array([len(m) for m in merged], np.int64)
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        self.starts = np.concatenate([self.starts, starts])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(merged), np.int32)])
        self.new = []

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of a run of pieces."""
        n = self.lengths[numbers]
        return self.ids[np.repeat(self.starts[numbers] - np.cumsum(n) + n, n) + np.arange(n.sum())]


class Encoder:
    """Texts to ids and back: each match of the pattern is encoded apart.

    A match that is a token itself is that token. A worker keeps the pieces that it has seen
    in the vocabulary's ``cache`` and starts anew beyond ``CACHE_PIECES`` of them, or
    ``CACHE_IDS`` ids.
    """

    def __init__(self, vocab: dict, pattern: str):
        self.vocab = vocab
        self.ranks = Ranks(vocab)
        self.split = splitter(pattern)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as int32."""
        first = 0
        while first < len(texts):
            end, chars = first, 0
            while end < len(texts) and (end == first or chars + len(texts[end]) <= BATCH_CHARS):
                chars += len(texts[end])
                end += 1
            yield from self._encode(texts[first:end])
            first = end

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        pieces = self.vocab["cache"].get("pieces")
        if pieces is None or len(pieces) > CACHE_PIECES or len(pieces.ids) > CACHE_IDS:
            pieces = self.vocab["cache"]["pieces"] = Pieces()
        number = pieces.__getitem__
        split = [np.array(list(map(number, self.split(t))), np.int64) for t in texts]
        raw = [p.encode() for p in pieces.new]
        known = [self.vocab["ids"].get(r) for r in raw]
        merged = iter(
            merge_pieces(self.ranks, [r for r, k in zip(raw, known, strict=True) if k is None])
        )
        pieces.add([[k] if k is not None else next(merged) for k in known])
        for numbers in split:
            yield pieces.of(numbers)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab["tokens"].__getitem__, ids))


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, ``ids`` (array of int) of the whole text.

    Null counts as empty and gives an empty array. The text of special tokens is ordinary
    text. Null and repeated ids are kept as they are; other columns are not read.
    """
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    vocab = spark.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab.value, pattern)
        for batch in batches:
            for part in small_batches(batch):
                texts = part.column(1).fill_null("").to_pylist()
                ids = list(encoder.encode(texts))
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["_id", "_ids"])

    rows = docs.select(named(id_col).alias("_id"), named(text_col).alias("_text"))
    fields = [
        T.StructField("_id", rows.schema[0].dataType),
        T.StructField("_ids", T.ArrayType(T.IntegerType(), False)),
    ]
    return rows.mapInArrow(run, T.StructType(fields)).select(
        F.col("_id").alias(id_col), F.col("_ids").alias("ids")
    )


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``, the bytes that the ids spell. Null ids decode to nothing."""
    vocab = encoded.sparkSession.sparkContext.broadcast(vocabulary(path)["tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = vocab.value
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            for part in small_batches(batch):
                texts = [
                    b"".join(map(spelled.__getitem__, ids or ())) for ids in part.column(at).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"]
                )

    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    return encoded.mapInArrow(run, schema)


def small_batches(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that what a task makes of it stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = decode(encode(docs, path, public_tokenizers.PATTERN), path)
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
