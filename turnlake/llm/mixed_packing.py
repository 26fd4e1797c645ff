"""Mixture-controlled packing: sequences of fixed length, each filled to target proportions.

The documents of a source form a queue of tokens. Deficit round-robin fills one sequence after
the other: a source earns its share of a sequence's tokens, sends what it has earned once that
is ``LEAST`` tokens or more, and carries the rest, its deficit, on to the next sequence.

The sequences are filled in chunks of about ``CHUNK_TOKENS``, side by side. Where each queue
stands at the start of a chunk follows from its length alone: the tokens that the source has
earned by then, rounded down to whole grains of ``LEAST``. What the rounding leaves is the
deficit that the chunk starts with. So a document's chunks follow from its place in its queue,
one shuffle brings the tokens of a chunk together, and a chunk is bounded for any source. Chunks
need not end where sequences end: a sequence across the border gets its pieces from both.

Tokens behind the last full sequence are cut into sequences of falling powers of two, so nothing
is padded.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.llm.store import named, text_batches, written

SEQUENCE_TOKENS = 2048
CHUNK_TOKENS = 1 << 21
LEAST = 16
END_ID = 1
# Shares of a queue are counted in parts of this.
WHOLE = 1 << 40
# Chunks whose sizes are summed in one task.
CHUNK_BLOCK = 1 << 16
# Texts are encoded together up to this many bytes; a longer text is taken alone.
CHUNK_BYTES = 4 << 20
# Characters that are cut into pieces at a time.
STRETCH = 4 << 20
# The normaliser and the cutting of words that pieces are made for.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
CUTS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PIECE}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
WORDS = re.compile("[^\x20\x09-\x0d]+").findall
SPACE = re.compile("[\x20\x09-\x0d]").search
# Kinds of Latin-1 characters, and their lower case.
OTHER, LETTER, NUMBER, SPACE_KIND = range(4)
KINDS = np.array(
    [
        next((k for k, p in enumerate((r"\p{L}", r"\p{N}", r"\s"), 1) if regex.match(p, chr(c))), OTHER)
        for c in range(256)
    ],
    np.uint8,
)
LOWER = bytes(ord(chr(c).lower()) for c in range(256))
# Ids, and strings, that a worker remembers.
CACHE_IDS = 1 << 22
CACHE_WORDS = 1 << 19


class Places(dict):
    """The places of strings in a table of ids; strings without one get the next."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str | bytes] = []

    def __missing__(self, key: str | bytes) -> int:
        self[key] = place = len(self)
        self.fresh.append(key)
        return place


def cut_pieces(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the matches of ``PIECE`` in Latin-1 text in lower case."""
    text = np.frombuffer(data, np.uint8)
    kind = KINDS[text]
    edge = np.ones(len(text) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    # An apostrophe that begins a match takes the letters of a contraction along.
    quote = np.flatnonzero((text == 39) & edge[:-1])
    after = np.concatenate([text, np.zeros(2, np.uint8)])
    first, second = after[quote + 1], after[quote + 2]
    two = np.zeros(len(quote), bool)
    for a, b in (b"re", b"ve", b"ll"):
        two |= (first == a) & (second == b)
    one = np.isin(first, np.frombuffer(b"stmd", np.uint8))
    edge[quote[one | two] + 1] = False
    edge[quote[one] + 2] = True
    edge[quote[two] + 2] = False
    edge[quote[two] + 3] = True
    starts = np.flatnonzero(edge[:-1] & (kind != SPACE_KIND))
    bounds = np.flatnonzero(edge)
    return starts, bounds[np.searchsorted(bounds, starts, "right")]


class WordIds:
    """The ids of texts, from those of their pieces, each of which the library encodes once.

    A tokenizer with the normaliser ``STEPS`` and the pattern ``PIECE`` neither joins nor
    normalises anything over ASCII white space, so its words may be encoded one by one. Where a
    text holds Latin-1 characters only, which the normaliser just puts in lower case, and no
    special token's string, the pattern cuts the words further, into fewer different strings.
    Texts for other tokenizers are encoded as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # Spark's tasks take all cores; threads of the library would only add memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        parts = json.loads(self.library.to_str())
        self.by_piece = (parts["normalizer"], parts["pre_tokenizer"]) == (STEPS, CUTS)
        self.byte_names = {}
        if self.by_piece:
            named_as = self.library.pre_tokenizer[1].pre_tokenize_str
            self.byte_names = {c: named_as(chr(c))[0][0] for c in range(256) if KINDS[c] != SPACE_KIND}
        self._forget()

    def _forget(self) -> None:
        self.known = Places()
        self.ids = np.zeros(0, self.width)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Encode the strings that have got a place since the last call; pieces are bytes."""
        if not self.known.fresh:
            return
        fresh, tokenize, number = self.known.fresh, self.library.model.tokenize, attrgetter("id")
        pieces = [k for k in fresh if isinstance(k, bytes)]
        spelled = b" ".join(pieces).decode("latin-1").translate(self.byte_names).split(" ")
        found = [list(map(number, tokenize(x))) for x in spelled] if pieces else []
        if len(pieces) < len(fresh):
            of_pieces = iter(found)
            found = [
                next(of_pieces)
                if isinstance(k, bytes)
                else self.library.encode(k, add_special_tokens=False).ids
                for k in fresh
            ]
        sizes = np.array([len(ids) for ids in found], np.int64)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        more = np.fromiter(chain.from_iterable(found), self.width, int(sizes.sum()))
        self.ids = np.concatenate([self.ids, more])
        self.known.fresh = []

    def _places(self, strings: pa.Array) -> np.ndarray:
        coded = strings.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        return places[coded.indices.to_numpy()]

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts; how many each text has)."""
        if len(self.ids) > CACHE_IDS or len(self.known) > CACHE_WORDS:
            self._forget()
        plain, other, other_rows = [], [], []
        for row, text in enumerate(texts):
            special = not self.by_piece or any(s in text for s in self.special)
            data = None if special else latin1(text)
            if data is None:
                words = WORDS(text) if self.by_piece else [text]
                other += words
                other_rows += [row] * len(words)
            plain.append(data or b"")
        data = b" ".join(plain).translate(LOWER)
        starts, ends = cut_pieces(data)
        row_ends = np.cumsum([len(p) + 1 for p in plain])
        rows = np.searchsorted(row_ends, starts, "right")
        # Pieces as slices of the text: those between them are left out.
        offsets = np.stack([starts, ends], axis=1).ravel().astype(np.int32)
        slices = pa.Array.from_buffers(
            pa.binary(),
            max(0, len(offsets) - 1),
            [None, pa.py_buffer(offsets if len(offsets) else np.zeros(1, np.int32)), pa.py_buffer(data)],
        )
        at = self._places(slices.take(pa.array(np.arange(0, max(0, len(offsets) - 1), 2))))
        if other:
            at = np.concatenate([at, self._places(pa.array(other, pa.string()))])
            rows = np.concatenate([rows, other_rows])
            order = np.argsort(rows, kind="stable")
            at, rows = at[order], rows[order]
        self._learn()
        sizes, firsts = self.sizes[at], self.starts[at]
        before = np.cumsum(sizes) - sizes
        out = self.ids[np.arange(int(sizes.sum())) + (firsts - before).repeat(sizes)]
        return out, np.bincount(rows, sizes, len(texts)).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with ``END_ID`` behind it; how many each text has)."""
        counts, found = np.zeros(len(texts), np.int64), [self.ids[:0]]
        rows, group, held = [], [], 0

        def flush() -> None:
            ids, sizes = self._encode(group)
            np.add.at(counts, rows, sizes)
            found.append(ids)

        for row, text in enumerate(texts.to_pylist()):
            for part in stretches(text) if self.by_piece else [text]:
                if held and held + len(part) > STRETCH:
                    flush()
                    rows, group, held = [], [], 0
                rows.append(row)
                group.append(part)
                held += len(part)
        if group:
            flush()
        return np.insert(np.concatenate(found), np.cumsum(counts), END_ID), counts + 1


def latin1(text: str) -> bytes | None:
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


def stretches(text: str) -> Iterator[str]:
    """A long text in stretches that end at ASCII white space."""
    at = 0
    while len(text) - at > STRETCH:
        space = SPACE(text, at + STRETCH)
        if not space:
            break
        yield text[at : space.start()]
        at = space.start()
    yield text[at:] if at else text


ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """This worker's encoder, which remembers pieces from one task to the next."""
    if path not in ENCODERS:
        ENCODERS[path] = WordIds(path)
    return ENCODERS[path]


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive runs of an array as a binary column."""
    ends = np.concatenate([[0], np.cumsum(sizes * data.itemsize)]).astype(np.int64)
    return pa.Array.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)]
    ).cast(pa.binary())


def queued_tokens(docs: DataFrame, path: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(_id, _source, _part, _local, _n, _ids): each text's ids and its place in its queue.

    ``_part`` is the task that read the document, ``_local`` the tokens of its source before it
    in that task; a queue goes through the tasks in their order.
    """
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = encoder(path), {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            texts = batch.column("_text").fill_null("")
            ends = np.cumsum(pc.binary_length(texts).to_numpy())
            first = 0
            while first < batch.num_rows:
                start = ends[first - 1] if first else 0
                end = max(first + 1, int(np.searchsorted(ends, start + CHUNK_BYTES, "right")))
                ids, sizes = words.encode(texts.slice(first, end - first))
                local = np.zeros(len(sizes), np.int64)
                sources = batch.column("_source").slice(first, end - first)
                for k, (source, size) in enumerate(zip(sources.to_pylist(), sizes.tolist())):
                    local[k] = seen.get(source, 0)
                    seen[source] = local[k] + size
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").slice(first, end - first),
                        sources,
                        pa.array(np.full(len(sizes), part, np.int32)),
                        pa.array(local),
                        pa.array(sizes),
                        binaries(ids, sizes),
                    ],
                    names=["_id", "_source", "_part", "_local", "_n", "_ids"],
                )
                first = end

    rows = docs.select(
        named(id_col).alias("_id"),
        named(source_col).cast("string").alias("_source"),
        named(text_col).alias("_text"),
    )
    id_type = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"_id {id_type}, _source string, _part int, _local long, _n long, _ids binary"
    )


def phase_shares(totals: dict[str | None, int], rest: int, targets: dict[str | None, float]):
    """By source, and for the rest: how much of a queue is used up at each phase's end.

    A phase ends when a queue runs dry; the others go on in their proportions. The shares are in
    parts of ``WHOLE``. Sources without a target share what the targets leave of 1, or the
    smallest target if they leave nothing, by their sizes.
    """
    left = 1 - sum(map(Fraction, targets.values()))
    weights = {s: Fraction(w) for s, w in targets.items()}
    sizes = {s: totals.get(s, 0) for s in targets}
    sizes["rest", None], weights["rest", None] = rest, left if left > 0 else min(weights.values())
    moments = sorted({sizes[s] / weights[s] for s in sizes if sizes[s]})
    shares = {
        s: [0, *[int(min(Fraction(1), weights[s] * m / sizes[s]) * WHOLE) if sizes[s] else WHOLE for m in moments]]
        for s in sizes
    }
    other = shares.pop(("rest", None))
    return shares, other


def _wide(column) -> F.Column:
    return column.cast("decimal(20,0)")


def _div(a, b):
    return F.call_function("div", a, b).cast("long")


def source_queues(tokens: DataFrame, targets: dict[str | None, float] | None):
    """(one row per source: its queue's cut into phases; number of phases)."""
    sums = tokens.groupBy("_source").agg(F.sum("_n").alias("_total"))
    sums = written(sums, "queues")
    if not targets:
        shares, other = {}, [0, WHOLE]
    else:
        if min(targets.values()) <= 0:
            raise ValueError("targets must be positive")
        some = F.col("_source").isin([s for s in targets if s is not None])
        if None in targets:
            some = some | F.col("_source").isNull()
        some = F.coalesce(some, F.lit(False))
        totals = {r._source: r._total for r in sums.where(some).collect()}
        rest = sums.where(~some).agg(F.sum("_total")).first()[0] or 0
        shares, other = phase_shares(totals, rest, targets)
    share = F.array(*map(F.lit, other))
    for source, used in shares.items():
        share = F.when(F.col("_source").eqNullSafe(F.lit(source)), F.array(*map(F.lit, used))).otherwise(share)

    def cut(used):
        return _div(_wide(F.col("_total")) * _wide(used), _wide(F.lit(WHOLE)))

    numbers = F.sequence(F.lit(0), F.lit(len(other) - 2))
    phases = F.transform(
        numbers,
        lambda k: F.struct(
            k.alias("k"), cut(F.get("_shares", k)).alias("low"), cut(F.get("_shares", k + 1)).alias("high")
        ),
    )
    return sums.withColumn("_shares", share).select("_source", phases.alias("_phases")), len(other) - 1


def segments(tokens: DataFrame, lanes: DataFrame, chunks: list[int], least: int, *more) -> DataFrame:
    """The parts of documents by the chunk that they are in.

    ``chunks`` holds the number of chunks of each phase. Rows: _chunk, _source, _queue (place in
    the queue), _carry (the queue's deficit at the chunk's start), _length, _start (place in the
    document) and ``more``.
    """
    same = (F.col("_part") == F.col("_lane")) & F.col("_source").eqNullSafe(F.col("_name"))
    begin = F.col("_offset") + F.col("_local")
    rows = tokens.join(lanes.withColumnsRenamed({"_part": "_lane", "_source": "_name"}), same)
    rows = rows.withColumns({"_begin": begin, "_end": begin + F.col("_n")})
    hit = F.filter("_phases", lambda p: (p["low"] < F.col("_end")) & (p["high"] > F.col("_begin")))
    counts = F.array(*[F.lit(c).cast("long") for c in chunks])
    firsts = F.array(*[F.lit(sum(chunks[:k])).cast("long") for k in range(len(chunks))])
    rows = rows.withColumn("_phase", F.explode(hit)).withColumns(
        {
            "_size": F.col("_phase.high") - F.col("_phase.low"),
            "_chunks": F.get(counts, F.col("_phase.k")),
            "_first": F.get(firsts, F.col("_phase.k")),
            # The part of the document in this phase, counted from the phase's start.
            "_a": F.greatest("_begin", "_phase.low") - F.col("_phase.low"),
            "_b": F.least("_end", "_phase.high") - F.col("_phase.low"),
        }
    )

    def chunk_of(x):
        """The last chunk that starts at or before x."""
        grain = _wide((F.floor(x / least).cast("long") + 1) * least)
        up = grain * _wide(F.col("_chunks")) + _wide(F.col("_size") - 1)
        return F.least(_div(up, _wide(F.col("_size"))), F.col("_chunks")) - 1

    def earned(chunk):
        return _wide(F.col("_size")) * _wide(chunk)

    def start_of(chunk):
        grains = _div(_div(earned(chunk), _wide(F.col("_chunks"))), F.lit(least).cast("long"))
        return F.when(chunk >= F.col("_chunks"), F.col("_size")).otherwise(grains * least)

    at = F.sequence(chunk_of(F.col("_a")), chunk_of(F.col("_b") - 1))
    rows = rows.withColumn("_c", F.explode(at))
    begins = start_of(F.col("_c"))
    rows = rows.withColumns(
        {
            "_carry": (earned(F.col("_c")) - _wide(begins) * _wide(F.col("_chunks"))).cast("double")
            / F.col("_chunks"),
            "_from": F.greatest(F.col("_a"), begins),
            "_to": F.least(F.col("_b"), start_of(F.col("_c") + 1)),
        }
    ).where("_from < _to")
    place = F.col("_phase.low") + F.col("_from")
    return rows.select(
        (F.col("_first") + F.col("_c")).alias("_chunk"),
        "_source",
        place.alias("_queue"),
        "_carry",
        (F.col("_to") - F.col("_from")).alias("_length"),
        (place - F.col("_begin")).alias("_start"),
        *more,
    )


def chunk_starts(sizes: DataFrame) -> DataFrame:
    """(_chunk, _place): the tokens before each chunk; sums run within blocks of chunks first."""
    block = F.floor(F.col("_chunk") / CHUNK_BLOCK)
    sizes = sizes.withColumn("_block", block)
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        sizes.groupBy("_block")
        .agg(F.sum("_tokens").alias("_sum"))
        .select("_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("_block").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    within = sizes.withColumn("_inside", F.coalesce(F.sum("_tokens").over(inside), F.lit(0)))
    return within.join(before, "_block").select(
        "_chunk", (F.col("_before") + F.col("_inside")).alias("_place")
    )


def sequence_bounds(low: int, high: int, total: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, ids) of the sequences that overlap tokens low..high-1, in order.

    Places have one entry more than ids, the end of the last. Behind the last full sequence
    come powers of two.
    """
    full = total // length
    ends = min(-(-high // length), full) * length
    places = list(range(low // length * length, ends + 1, length))
    ids = [p // length for p in places[:-1]]
    at, rest, number = full * length, total - full * length, full
    if high > at:
        places = places or [at]
        while rest:
            size = 1 << (rest.bit_length() - 1)
            if at + size > low and at < high:
                places.append(at + size)
                ids.append(number)
            elif at + size <= low:
                places = [at + size]
            at, rest, number = at + size, rest - size, number + 1
    return np.array(places, np.int64), np.array(ids, np.int64)


def fill(budgets: np.ndarray, carry: np.ndarray, capacities: np.ndarray, least: int):
    """(window, source, tokens) of each share taken, windows in order, by deficit round-robin.

    The budgets sum to the capacities. In each window a source's deficit grows by its share of
    the window; a source sends its deficit if that is ``least`` or more. What is lacking then
    comes from the sources with the greatest deficits, what is too much stays with the last of
    the round, and another source is the first of the next round.
    """
    left, rate = budgets.copy(), budgets / budgets.sum()
    # Rounding down held back this much of all queues, so the chunk starts that much earlier.
    deficit = carry - rate * carry.sum()
    numbers, out = np.arange(len(budgets)), []
    for w, room in enumerate(capacities.tolist()):
        deficit = deficit + rate * room
        take = np.minimum(np.floor(deficit + 1e-6).astype(np.int64), left).clip(min=0)
        take[(take < least) & (take < left)] = 0
        order = (numbers + w) % len(numbers)
        sums = np.cumsum(take[order])
        if sums[-1] > room:
            take[order] = np.diff(np.minimum(sums, room), prepend=0)
        lack = room - int(take.sum())
        for most in (least, None):
            if not lack:
                break
            spare = left - take
            some = np.flatnonzero(spare)
            some = some[np.argsort(-(deficit - take)[some], kind="stable")]
            give = spare[some] if most is None else np.minimum(spare[some], most)
            give = np.diff(np.minimum(np.cumsum(give), lack), prepend=0)
            take[some] += give
            lack -= int(give.sum())
        left -= take
        deficit = deficit - take
        served = order[take[order] > 0]
        out.append((np.full(len(served), w), served, take[served]))
    return tuple(np.concatenate(c) for c in zip(*out))


PIECES = "_start long, _length long, _ids binary, _n long, _sequence long, _offset long, _source string"


def chunk_pieces(total: int, length: int, least: int, width: np.dtype):
    """The function that packs the tokens of one chunk."""

    def run(chunk: pa.Table) -> pa.Table:
        chunk = chunk.combine_chunks().sort_by([("_source", "ascending"), ("_queue", "ascending")])
        coded = chunk["_source"].combine_chunks().dictionary_encode(null_encoding="encode")
        sizes = chunk["_length"].to_numpy()
        by_row = coded.indices.to_numpy()  # rising, as rows are in order
        budgets = np.bincount(by_row, sizes).astype(np.int64)
        first_rows = np.searchsorted(by_row, np.arange(len(budgets)))
        carry = chunk["_carry"].to_numpy()[first_rows]
        place = chunk["_place"][0].as_py()
        count = int(sizes.sum())
        bounds, numbers = sequence_bounds(place, place + count, total, length)
        edges = bounds.clip(place, place + count)
        window, source, taken = fill(budgets, carry, np.diff(edges), least)

        # All queues side by side: takes and documents both cut this line.
        inside = np.cumsum(taken) - taken + place - bounds[window]  # place in the sequence
        by_queue = np.lexsort((window, source))
        window, source, taken, inside = (x[by_queue] for x in (window, source, taken, inside))
        takes, docs = np.cumsum(taken) - taken, np.cumsum(sizes) - sizes
        cuts = np.union1d(takes, docs)
        lengths = np.diff(cuts, append=count)
        take = np.searchsorted(takes, cuts, "right") - 1
        doc = np.searchsorted(docs, cuts, "right") - 1
        ids = np.frombuffer(b"".join(chunk["_ids"].to_pylist()), width).astype("<u4")
        return pa.table(
            {
                "_id": pc.take(chunk["_id"], pa.array(doc)),
                "_start": chunk["_start"].to_numpy()[doc] + cuts - docs[doc],
                "_length": lengths,
                "_ids": binaries(ids, lengths),
                "_n": chunk["_n"].to_numpy()[doc],
                "_sequence": numbers[window[take]],
                "_offset": inside[take] + cuts - takes[take],
                "_source": pc.take(chunk["_source"], pa.array(doc)),
            }
        )

    return run


def packed_pieces(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    targets: dict[str | None, float] | None = None,
    length: int = SEQUENCE_TOKENS,
    least: int = LEAST,
    chunk_tokens: int = CHUNK_TOKENS,
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids``, ``doc_tokens``, ``sequence_id``,
    ``offset`` and ``source``.

    A document is its ids and ``END_ID``; ``start`` counts its ids before the piece, ``ids`` holds
    the piece's as little-endian 32-bit numbers. Each id is in one piece, and the pieces of a
    sequence fill it from 0 without gaps. All sequences hold ``length`` tokens, but for a tail of
    powers of two. ``targets`` gives sources (None: null) their proportion of each sequence; once
    a source runs dry the others share its part. By default a source's target is its share of all
    tokens, so that all queues last to the end.

    Null and empty texts are the end id alone. Null is a source of its own, null and repeated ids
    and repeated rows are documents like others, and further columns are not read. No documents
    give no rows.
    """
    spark = docs.sparkSession
    tokens = written(queued_tokens(docs, path, id_col, text_col, source_col), "tokens")
    places = tokens.drop("_ids")
    queues, n_phases = source_queues(places, targets)
    earlier = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    lanes = (
        places.groupBy("_part", "_source")
        .agg(F.sum("_n").alias("_sum"))
        .select("_part", "_source", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    )
    queues = queues.withColumnRenamed("_source", "_queue_source")
    lanes = lanes.join(queues, F.col("_source").eqNullSafe(F.col("_queue_source")))
    # Written, so that Spark knows its size when it chooses how to join it with the tokens.
    lanes = written(lanes.drop("_queue_source"), "lanes")

    phase = F.explode("_phases").alias("_phase")
    volumes = {
        r.k: r.n
        for r in queues.select(phase)
        .groupBy(F.col("_phase.k").alias("k"))
        .agg(F.sum(F.col("_phase.high") - F.col("_phase.low")).alias("n"))
        .collect()
    }
    chunks = [max(1, -(-volumes.get(k, 0) // chunk_tokens)) for k in range(n_phases)]
    sizes = segments(places, lanes, chunks, least).groupBy("_chunk")
    sizes = written(sizes.agg(F.sum("_length").alias("_tokens")), "chunks")
    total = sizes.agg(F.sum("_tokens")).first()[0] or 0
    starts = written(chunk_starts(sizes), "starts")

    width = WordIds(path).width
    ids = F.expr(f"substring(_ids, CAST(_start AS INT) * {width.itemsize} + 1, CAST(_length AS INT) * {width.itemsize})")
    rows = segments(tokens, lanes, chunks, least, "_id", "_n", "_ids").withColumn("_ids", ids)
    id_type = tokens.schema["_id"].dataType.simpleString()
    pieces = (
        rows.join(starts, "_chunk")
        .groupBy("_chunk")
        .applyInArrow(chunk_pieces(total, length, least, width), f"_id {id_type}, {PIECES}")
    )
    return pieces.select(
        F.col("_id").alias(id_col),
        F.col("_start").alias("start"),
        F.col("_length").alias("length"),
        F.col("_ids").alias("ids"),
        F.col("_n").alias("doc_tokens"),
        F.col("_sequence").alias("sequence_id"),
        F.col("_offset").alias("offset"),
        F.col("_source").alias("source"),
    )


def sequences(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per sequence: its id, ``n_tokens``, ``ids`` (little-endian, 32 bits each) and the
    ``parts`` of documents in it, in order.

    A sequence has a bounded number of pieces. Null ids stay null; no pieces give no rows.
    """
    part = F.struct("offset", "length", named(id_col).alias("id"), "start", "source", "ids")
    whole = F.sort_array(F.collect_list(part))
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), whole.alias("_parts"))
    ids = F.aggregate("_parts", F.lit(b""), lambda out, p: F.concat(out, p["ids"]))
    parts = F.transform("_parts", lambda p: p.dropFields("ids"))
    return joined.select("sequence_id", "n_tokens", ids.alias("ids"), parts.alias("parts"))


def op13_mixed_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = packed_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
