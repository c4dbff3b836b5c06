"""Vector codes against a plain loop, the curve and the boxes, and edge cases."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablehaul.llm import codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, error long"


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """The rule as it is stated, vector by vector."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // parts
    cut = [[v[p * d : (p + 1) * d] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda u, book: min((sum((a - b) ** 2 for a, b in zip(u, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[near(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(members[k]) for x in zip(*members[k], strict=True)] if k in members else e for k, e in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(dist for dist, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], sha) for (i, _, label), f, e in zip(kept, found, errors, strict=True))


def as_query(spark, rows, n=3, **given):
    frame = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], VECTORS).repartition(n)
    coded, books = codes.compress(frame, **given)
    got = codes.with_label_error(coded.cache())
    return Counter((r.vec_id, bytes(r.code).hex(), r.error, r.label_error, codes.digest(books)) for r in got.collect())


def some_vectors(seed, n=300, size=32):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(size)] for _ in range(5)]
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f32([x + rng.gauss(0, 0.05) for x in centres[i % 5]]), i % 4 or None) for i in range(n)]
    hot = rows[9][1]
    rows += [(n + i, hot, 7) for i in range(150)]
    rows += [(1000, None, 1), (1001, [*hot[:-1], None], 1), (1002, [*hot[:-1], float("nan")], 1), (1003, [*hot[:-1], float("-inf")], 2)]
    rows += [(5, rows[5][1], 1), (None, rows[20][1], None), (2000, [0.0] * size, 1), (2001, f32([-0.0001] * size), 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_codes_equal_plain_loop(spark, seed):
    rows = some_vectors(seed, n=300 if seed else 40)
    assert as_query(spark, rows) == plain_codes(rows)


def test_huge_components_and_few_vectors(spark):
    rows = [(i, [float(np.float32((i - 3) * 10.0**i))] * 16, i) for i in range(12)]
    assert as_query(spark, rows) == plain_codes(rows)
    far = [(0, [3.0e38] * 16, 1), (1, [-3.0e38] * 16, 1), (2, [0.0] * 16, None)]
    assert len(as_query(spark, far)) == 3
    assert as_query(spark, rows[:1]) == plain_codes(rows[:1])


def test_lengths_that_cannot_be_cut_are_left_out(spark):
    rows = [(0, [], 1), (1, [0.5] * 15, 1), (2, [0.25] * 16, 1), (3, [0.5] * 32, 1), (4, [0.5] * 16, 1)]
    assert {r[0] for r in as_query(spark, rows)} == {2, 4}
    empty = spark.createDataFrame([], VECTORS)
    coded, books = codes.compress(empty)
    assert books == [] and codes.with_label_error(coded).count() == 0


def test_curve_visits_neighbours():
    for positions, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * positions, indexing="ij"), -1).reshape(-1, positions)
        place = codes.curve_place([c.astype(np.int64) for c in grid.T], bits)
        assert sorted(place.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_boxes_spare_work_and_keep_every_winner():
    rng = np.random.default_rng(4)
    values = rng.integers(-100, 100, (4096, 4))
    ordered = values[np.argsort(codes.hilbert(values), kind="stable")]
    at = codes.starts_of(len(ordered))
    boxes = [f(ordered, at, axis=0) for f in (np.minimum.reduceat, np.maximum.reduceat, np.add.reduceat)]
    part = codes.Part(len(ordered), 4, False, ordered.astype("<i4").tobytes(), np.arange(4096, dtype="<i4").tobytes(), *(b.tobytes() for b in boxes))
    book = values[:64]
    short = part.shortlists(book)
    squared = ((ordered[:, None, :] - book) ** 2).sum(axis=2)
    assert short[np.arange(4096) // codes.BLOCK, squared.argmin(axis=1)].all()
    assert short.mean() < 0.5
    chosen, errors = part.coded(book)
    assert (chosen == squared.argmin(axis=1)).all() and (errors == squared.min(axis=1)).all()
    few = book[:2] * 50
    counts, sums = np.zeros(2, np.int64), np.zeros((2, 4), np.int64)
    assert part.sum_into(few, counts, sums) > 10 and counts.sum() == 4096 and (sums.sum(axis=0) == values.sum(axis=0)).all()
