"""Largest integer inner products against brute force."""

import math

import numpy as np
import pytest

from lexigrid.llm import norm_buckets


def brute(vectors, queries, k, scale):
    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = lambda v: [math.floor(scale * x) for x in v]
    rows = {(i, tuple(v)) for i, v in vectors if i is not None and good(v)}
    out = []
    for i, v in {(i, tuple(v)) for i, v in queries if i is not None and good(v)}:
        scores = [(-sum(a * b for a, b in zip(whole(v), whole(w))), j) for j, w in rows if j != i and len(w) == len(v)]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, length long, bucket string")


def check(spark, rows, queries, k=5, scale=16, **more):
    got = norm_buckets.top_products(frame(spark, rows), frame(spark, queries), k, scale, **more).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, queries, k, scale)


def skewed(n, seed, width=6):
    rng = np.random.default_rng(seed)
    lengths = rng.lognormal(0, 1, n)
    return [(int(k), [float(x) for x in lengths[k] * rng.normal(size=width)]) for k in range(n)]


@pytest.mark.parametrize("numbers", [60, 600, 1 << 21])
def test_lengths_of_all_sizes(spark, numbers):
    rows = skewed(400, 1)
    check(spark, rows, rows[::25], bucket_numbers=numbers, block_numbers=numbers)


def test_ties_repeated_rows_and_one_hot_length(spark):
    rows = [(k, [1.0, 0.5, -0.25]) for k in range(120)] * 2 + [(k, [0.0, 0.0, 0.0]) for k in range(200, 215)] + skewed(100, 2, 3)
    check(spark, rows, [rows[5], rows[5], rows[240], rows[-1]], bucket_numbers=30)


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [-1.0, -1.0]),
            (7, [1.0, 1.0]), (8, [1e-9, -1e-9]), (9, []), (10, [1.0]), (11, [2e6, 3e6]), (11, [2.0, 3.0]), (12, [5e7, 5e7])]
    check(spark, rows, rows, k=3)
    assert norm_buckets.top_products(frame(spark, rows[:1]), frame(spark, rows)).count() == 0
    assert norm_buckets.top_products(frame(spark, rows), frame(spark, rows[:1])).count() == 0


def test_scores_beyond_a_long_are_an_error():
    with pytest.raises(OverflowError):
        norm_buckets.products(np.array([[3e9, 3e9]]), np.array([[3e9, 3e9]]))
    assert norm_buckets.products(np.array([[2.0**31, 1.0]]), np.array([[2.0**30, 1.0]]))[0, 0] == 2**61 + 1


def test_both_prunings_are_chosen_and_lose_nothing():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    near = np.repeat(centres, 40, axis=0) * rng.uniform(0.9, 1.1, (1200, 1)) + rng.normal(size=(1200, 16)) * 0.02
    vectors = np.floor(1024 * near)
    bucket = norm_buckets.Bucket(np.arange(1200), vectors)
    chosen = set()
    for q in vectors[::37]:
        length = np.sqrt(q @ q)
        truth = bucket.vectors @ q
        for floor in (np.sort(truth)[-10], np.sort(truth)[-300], 0.0, -np.inf, length * bucket.lengths[0] * 1.01):
            looked = bucket.candidates(q, length, floor)
            chosen.add(type(looked))
            places = set(range(looked)) if isinstance(looked, int) else set(looked.tolist())
            assert set(np.nonzero(truth >= floor)[0].tolist()) <= places
            if not isinstance(looked, int):
                assert len(places) < 1200 * norm_buckets.NARROW + 1
    assert chosen == {int, np.ndarray}


def test_later_buckets_are_not_sent(spark, monkeypatch):
    """A query whose floor no later bucket reaches is in no later wave."""
    seen = []
    wave = norm_buckets._wave
    monkeypatch.setattr(norm_buckets, "_wave", lambda held, sent, k: seen.append(sent.count()) or wave(held, sent, k))
    rows = [(k, [float(2.0 ** -(k // 10)), 0.1]) for k in range(300)]
    check(spark, rows, rows[:10], k=3, scale=1 << 12, bucket_numbers=40)
    assert len(seen) == 1 and seen[0] == 10
