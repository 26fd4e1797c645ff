from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnlake.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, `_id.x` int, _label int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 1, 2) for r in rows], SCHEMA)


def brute_force(rows, rounds=4):
    """{(id, label, code, error, label error)}, and the final entries as one list."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    longest = max((len(r[1]) for r in kept), default=0)
    width = -(-longest // 4)
    limit = vector_codes.largest_component(4 * width)

    def whole(x):
        x = float(np.float32(x))
        return int(min(max(math.floor(1024 * x), -limit), limit))

    vectors = [[whole(x) for x in r[1]] + [0] * (4 * width - len(r[1])) for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, vectors[i]))
    cut = [[v[q * width : (q + 1) * width] for q in range(4)] for v in vectors]
    books = [[cut[i][q] for i in order[:256]] for q in range(4)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for turn in range(rounds + 1):
        found = [[nearest(parts[q], books[q]) for q in range(4)] for parts in cut]
        if turn == rounds:
            break
        for q in range(4):
            for e in range(len(books[q])):
                own = [parts[q] for parts, f in zip(cut, found) if f[q][1] == e]
                if own:
                    books[q][e] = [sum(c) // len(own) for c in zip(*own)]
    errors = [sum(d for d, _ in f) for f in found]
    sums = {}
    for r, e in zip(kept, errors):
        sums[r[2]] = sums.get(r[2], 0) + e
    out = sorted(
        (str(r[0]), "".join(f"{e:02x}" for _, e in f), e0, min(sums[r[2]], vector_codes.LONG_MAX))
        for r, f, e0 in zip(kept, found, errors)
    )
    return out, books


def check(spark, rows, **options):
    got = vector_codes.vector_codes(frame(spark, rows), **options).collect()
    want, books = brute_force(rows)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got) == want
    if got:
        digest = vector_codes.codebook_digest(np.array(books, dtype=np.int64))
        assert {r.codebooks_sha256 for r in got} == {digest}


@pytest.mark.parametrize("bounds", [1, 2, 16, 255])
def test_like_brute_force(spark, bounds):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(9, 8))
    rows = []
    for i in range(400):
        v = centers[i % 9 if i % 3 else 0] + rng.normal(size=8) * 0.2
        rows.append((i * 7 % 401, [float(x) for x in np.round(v, 1)], [None, 1, 2][i % 3]))
    check(spark, rows, first_bounds=bounds)


def test_edges(spark):
    rows = [
        (1, [0.5, -0.25, 0.125, 1.0], 1),
        (2, None, 1),
        (3, [0.1, None, 0.2, 0.3], 1),
        (4, [float("nan"), 0.0, 0.0, 0.0], 2),
        (5, [float("inf"), 0.0, 0.0, 0.0], 2),
        (1, [0.5, -0.25, 0.125, 1.0], 1),
        (1, [0.25, 0.25, 0.25, 0.25], None),
        (None, [0.0, 0.0, 0.0, 0.0], None),
        (6, [], 3),
        (7, [1.0, 2.0, 3.0, 4.0, 5.0], 3),
        (8, [3e38, -3e38, 1.0, 1.0], 4),
        (9, [-3e38, 3e38, 1.0, 1.0], 4),
    ]
    check(spark, rows)
    for few in (rows[:1], rows[1:5], rows[8:9]):
        check(spark, few)
    assert vector_codes.vector_codes(frame(spark, [])).count() == 0


def test_ties_and_repeats(spark):
    rows = [(i, [float(i % 2), 0.0, float(i % 5), 1.0], i % 2) for i in range(600)]
    check(spark, rows, first_bounds=3)


def plain(points, entries):
    d = ((points[:, None] - entries[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(0, 12), st.integers(0, 5))
@settings(max_examples=60, deadline=None)
def test_bounds_never_lose_the_nearest(seed, k, b, drop):
    rng = np.random.default_rng(seed)
    points, entries = rng.integers(-9, 9, (50, 3)), rng.integers(-9, 9, (k, 3))
    b = min(b, k - 1)
    near, low, square = vector_codes.full_search(points, entries, b)
    for _ in range(4):
        want, least = plain(points, entries)
        assert (near[:, 0] == want).all() and (square == least).all()
        moved_entries = entries + rng.integers(-2, 3, entries.shape) * (rng.random((k, 1)) < 0.5)
        moved = vector_codes.root_up(((moved_entries - entries) ** 2).sum(1))
        entries, fewer = moved_entries, max(0, b - drop)
        near, low, square, _ = vector_codes.bounded_search(points, near, low, entries, moved, fewer)
        b = fewer


def test_bounds_save_comparisons():
    rng = np.random.default_rng(2)
    entries = rng.integers(-1000, 1000, (256, 16))
    points = entries[rng.integers(0, 256, 3000)] + rng.integers(-40, 40, (3000, 16))
    near, low, _ = vector_codes.full_search(points, entries, 16)
    later = entries + rng.integers(-3, 4, entries.shape)
    moved = vector_codes.root_up(((later - entries) ** 2).sum(1))
    *_, depth = vector_codes.bounded_search(points, near, low, later, moved, 16)
    assert (depth == 0).mean() > 0.9 and (depth < 0).mean() < 0.01


def test_roots():
    x = np.array([0, 1, 2, 3, 4, 8, 9, 2**53 - 1, 2**60, 2**62 - 1, 10**18], np.int64)
    assert vector_codes.root_down(x).tolist() == [math.isqrt(int(v)) for v in x]
    assert vector_codes.root_up(x).tolist() == [math.isqrt(int(v) - 1) + 1 if v else 0 for v in x]
