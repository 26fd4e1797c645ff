"""Token counts at every prefix by dynamic programming, for byte-level BPE.

For each prefix of a piece, exactly one token can come last: a token that ends there and that
stays apart from the last token of the prefix before it. So the count of a prefix is the count
of a shorter one plus one, and one pass from left to right gives the exact count of every
prefix. Truncation and budget questions are then look-ups.

Two tokens stay apart unless, while both are built from their bytes in order of rank, a merge
over their border comes first. Only the tokens next to the border matter: the right spine of
the left token's merges and the left spine of the right token's.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.llm.bpe_encode import small_batches
from turnlake.llm.pieces import splitter
from turnlake.llm.store import named, text_batches

# Pieces and token pairs that a worker remembers.
CACHE_PIECES = 500_000
CACHE_PAIRS = 2_000_000
# Fixed: the byte-level split, and the bytes that byte-level vocabularies write as themselves.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
SELF_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
LAST = 1 << 40


def vocabulary(path: str) -> dict:
    """A byte-level BPE vocabulary file of the tokenizers library, as plain data."""
    with open(path, encoding="utf-8") as file:
        parsed = json.load(file)
    model = parsed["model"]
    letters = {chr(b): b for b in SELF_BYTES}
    others = [b for b in range(256) if b not in set(SELF_BYTES)]
    letters |= {chr(256 + i): b for i, b in enumerate(others)}

    def spelled(token: str) -> bytes:
        return bytes(letters[c] for c in token)

    added = {t["content"] for t in parsed["added_tokens"]}
    ids = {spelled(t): i for t, i in model["vocab"].items() if t not in added}
    merges = {}
    parts = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = (spelled(t) for t in (pair.split(" ") if isinstance(pair, str) else pair))
        merges[ids[left] << 32 | ids[right]] = rank
        # The first merge that makes a token is the one that builds it.
        parts.setdefault(ids[left + right], (rank, ids[left], ids[right]))
    # The longest token that ends in these bytes, at most three.
    reach: dict[bytes, int] = {}
    for token in ids:
        for n in (1, 2, 3):
            end = token[-n:]
            reach[end] = max(reach.get(end, 0), len(token))
    return {
        "ids": ids,
        "merges": merges,
        "parts": parts,
        "reach": reach,
        "special": sorted(added, key=len, reverse=True),
        "cache": {},
    }


class PrefixCounter:
    """Exact token counts of all prefixes of pieces and texts.

    A special token's string in a text is one token, and splits the text, as the library does
    by default.
    """

    def __init__(self, vocab: dict):
        self.vocab = vocab
        self.find = splitter(PATTERN)
        special = "|".join(map(regex.escape, vocab["special"]))
        self.special = regex.compile(f"({special})") if special else None

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(rank at which it is made, token) next to the border, from a byte to the whole."""
        spine = []
        while token in self.vocab["parts"]:
            rank, *halves = self.vocab["parts"][token]
            spine.append((rank, token))
            token = halves[side]
        spine.append((-1, token))
        return spine[::-1]

    def apart(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, are not merged over their border."""
        a, b = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            grow_a = a[i + 1][0] if i + 1 < len(a) else LAST
            grow_b = b[j + 1][0] if j + 1 < len(b) else LAST
            over = self.vocab["merges"].get(a[i][1] << 32 | b[j][1], LAST)
            # Of equal ranks the leftmost goes first: inside the left token, over, inside the right.
            if over < grow_a and over <= grow_b and over < LAST:
                return False
            if grow_a == grow_b == LAST:
                return True
            if grow_a <= grow_b:
                i += 1
            else:
                j += 1

    def piece(self, raw: bytes) -> list[int]:
        """Token counts of the piece's prefixes of 0, 1, 2, ... bytes."""
        known, reach, pairs = self.vocab["ids"].get, self.vocab["reach"].get, self._pairs()
        counts, last = [0] * (len(raw) + 1), [-1] * (len(raw) + 1)
        for end in range(1, len(raw) + 1):
            # Without a token that ends in the last three bytes, two are the most.
            longest = reach(raw[max(0, end - 3) : end], 2)
            for start in range(max(0, end - longest), end):
                token = known(raw[start:end])
                if token is None:
                    continue
                if start:
                    pair = last[start] << 32 | token
                    apart = pairs.get(pair)
                    if apart is None:
                        apart = pairs[pair] = self.apart(last[start], token)
                    if not apart:
                        continue
                counts[end], last[end] = counts[start] + 1, token
                break
        return counts

    def _pairs(self) -> dict[int, bool]:
        pairs = self.vocab["cache"].setdefault("pairs", {})
        if len(pairs) > CACHE_PAIRS:
            pairs.clear()
        return pairs

    def _pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        parts = self.special.split(text) if self.special else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield part, True
            else:
                for piece in self.find(part):
                    yield piece, False

    def total(self, text: str) -> int:
        """Tokens of the whole text."""
        parts = self.special.split(text) if self.special else [text]
        known = self.vocab["cache"].get("totals")
        if known is None or len(known) > CACHE_PIECES:
            known = self.vocab["cache"]["totals"] = Totals(self)
        # Every other part is a special token.
        return len(parts) // 2 + sum(sum(map(known.__getitem__, self.find(p))) for p in parts[::2])

    def prefixes(self, text: str) -> np.ndarray:
        """Exact token counts of ``text[:0]``, ``text[:1]``, ..., ``text[:len(text)]``.

        Where a cut changes the split before it (white space before a word, an apostrophe's
        suffix, a special token), the few characters from the last settled border on are
        split again.
        """
        out = np.zeros(len(text) + 1, np.int64)
        at, settled, before = 0, 0, 0  # tokens before the settled border
        done = 0
        previous_space = False
        for piece, special in self._pieces(text):
            # White space before this piece may split otherwise once the text ends in it.
            if not previous_space:
                settled, before = at, done
            end = at + len(piece)
            counts = None if special else self.piece(piece.encode())
            plain = counts is not None and not previous_space and not piece.startswith("'")
            width = 0
            for k in range(at + 1, end + 1):
                if plain:
                    width += len(text[k - 1].encode())
                    out[k] = done + counts[width]
                else:
                    out[k] = before + self.total(text[settled:k])
            done += 1 if special else counts[-1]
            previous_space = not special and piece.isspace()
            at = end
        return out


class Totals(dict):
    """The token counts of whole pieces, counted when first asked for."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        self[piece] = total = self.counter.piece(piece.encode())[-1]
        return total


def cut_for_budget(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens, from all prefix counts."""
    return int(np.flatnonzero(counts <= budget)[-1])


def truncated_count(counts: np.ndarray, characters: int) -> int:
    """Tokens of the text cut after so many characters, from all prefix counts."""
    return int(counts[min(characters, len(counts) - 1)])


def _counted(docs: DataFrame, path: str, id_col: str, text_col: str, column: T.StructField, of):
    text_batches(docs.sparkSession)
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(vocab.value)
        for batch in batches:
            for part in small_batches(batch):
                texts = part.column(1).fill_null("").to_pylist()
                sizes = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array([of(counter, t) for t in texts])],
                    names=["_id", "_bytes", "_counts"],
                )

    rows = docs.select(named(id_col).alias("_id"), named(text_col).alias("_text"))
    fields = [T.StructField("_id", rows.schema[0].dataType), T.StructField("_bytes", T.LongType()), column]
    return rows.mapInArrow(run, T.StructType(fields))


def token_counts(
    docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_tokens`` and whether that is over ``limit``.

    Null counts as empty: no bytes, no tokens. Null and repeated ids are kept as they are;
    other columns are not read.
    """
    rows = _counted(
        docs, path, id_col, text_col, T.StructField("_counts", T.LongType()), lambda c, t: c.total(t)
    )
    return rows.select(
        F.col("_id").alias(id_col),
        F.col("_bytes").alias("n_bytes"),
        F.col("_counts").alias("n_tokens"),
        (F.col("_counts") > limit).alias("over_limit"),
    )


def prefix_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id and ``counts``, the tokens of each of its prefixes.

    ``counts[k]`` (from 0) is the exact count of the text's first k characters, so a text of n
    characters has n + 1 counts; null counts as empty and has one, 0.
    """
    column = T.StructField("_counts", T.ArrayType(T.LongType(), False))
    rows = _counted(docs, path, id_col, text_col, column, lambda c, t: c.prefixes(t).tolist())
    return rows.select(F.col("_id").alias(id_col), F.col("_counts").alias("counts"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), 512)
