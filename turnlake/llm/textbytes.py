"""Words of many texts at once, as arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Texts are taken together up to this many bytes; a longer text is taken alone.
CHUNK_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Odd multiplier of the rolling hash, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.Generator(np.random.PCG64(3)).integers(
    1, 1 << 63, 256, dtype=np.uint64
)


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offset_buffer, data = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, row) of each word in order; words have no white space, A-Z count as a-z."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    edge = np.ones(len(data) + 1, bool)  # whether a word may begin here
    edge[1:-1] = ~inside[:-1]
    edge[offsets[:-1]] = True
    starts = np.flatnonzero(inside & edge[:-1])
    stop = np.ones(len(data), bool)
    stop[:-1] = ~inside[1:]
    inner = offsets[1:-1]
    stop[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(inside & stop) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    powers = np.full(len(data), _BASE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[_LOWER[data]] * powers, out=sums[1:])
    powers[1:] = _INVERSE
    powers[0] = 1
    np.cumprod(powers, out=powers)
    return mixed((sums[ends] - sums[starts]) * powers[starts] + (ends - starts).astype(np.uint64)), rows


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n: int, n_rows: int):
    """(hash, row) of each run of ``n`` words; a text with fewer words is one run."""
    salts = [np.uint64(x) for x in (mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1))]
    counts = np.bincount(rows, minlength=n_rows)
    firsts = np.cumsum(counts) - counts
    whole, whole_rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= n:
        full = len(words) - n + 1
        whole = sum(words[k : full + k] * salts[k] for k in range(n))
        same = rows[:full] == rows[n - 1 :]
        whole, whole_rows = whole[same], rows[:full][same]
    short = np.flatnonzero((counts > 0) & (counts < n))
    part = counts[short].astype(np.uint64)
    for k in range(n - 1):
        has = counts[short] > k
        part[has] += words[firsts[short[has]] + k] * salts[k]
    hashes = np.concatenate([whole, part])
    at = np.concatenate([whole_rows, short])
    order = np.argsort(at, kind="stable")
    return mixed(hashes[order]), at[order]
