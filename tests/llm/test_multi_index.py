"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import multi_index


def brute(rows, every=10, positives=5, negatives=5, low=80, high=100, scale=256):
    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = {(i, y, tuple(math.floor(scale * x) for x in v), tuple(v)) for i, v, y in rows if i is not None and y is not None and good(v)}
    out = []
    for i, y, v, _ in kept:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w, _ in kept if j != i and len(w) == len(v))
        for s, p, _ in [c for c in scored if c[2] == y][:positives]:
            window = [(t, j) for t, j, z in scored if z != y and low * -s <= 100 * -t <= high * -s]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j) in enumerate(window[:negatives])]
    return sorted(out)


def mined(spark, rows, every=10, **more):
    frame = spark.createDataFrame([(i, v, y, 1, "x") for i, v, y in rows], "vec_id long, embedding array<double>, label int, shard int, cell string")
    return sorted(tuple(r) for r in multi_index.mine(frame, F.col("vec_id") % every == 0, **more).collect())


def clustered(n, seed, width=8, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    return [(int(k), (centres[k % 12] + spread * rng.normal(size=width)).tolist(), int(rng.integers(4))) for k in range(n)]


@pytest.mark.parametrize("numbers, codes", [(1 << 20, 16), (400, 3)])
def test_clusters(spark, numbers, codes):
    rows = clustered(360, 1)
    assert mined(spark, rows, shard_numbers=numbers, block_numbers=numbers // 4, codes=codes) == brute(rows)


def test_ties_and_one_hot_cell(spark):
    rows = [(k, [0.5, 0.25, -0.5], k % 3) for k in range(150)] + [(k, [0.0, 0.0, 0.0], k % 2) for k in range(150, 190)] + clustered(60, 2, 3)[7:]
    assert mined(spark, rows + rows[:40], shard_numbers=90) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, None, 1), (10, [], 1), (11, [], 1), (12, [], 2), (20, [1.0, None], 1), (30, [float("nan"), 1.0], 1), (40, [float("inf"), 1.0], 2),
            (50, [1.0, 2.0], None), (None, [1.0, 1.0], 1), (60, [1.0, 1.0], 1), (61, [1.0, 0.9], 1), (62, [0.9, 1.0], 2), (63, [1.0, 1.0], 2),
            (70, [2.0], 1), (71, [3.0], 1), (72, [2.5], 3), (80, [-1.0, -1.0], 5), (90, [1e-9, -1e-9], 2)]
    assert mined(spark, rows, negatives=2) == brute(rows, negatives=2)
    assert mined(spark, rows[:1]) == []
    assert mined(spark, rows, every=1000) == brute(rows, every=1000)


def test_sums_come_in_order():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=7).round(1), rng.normal(size=5).round(1)
    a[2] = -np.inf
    got = list(multi_index.multi_sequence(a, b))
    assert [s for s, _, _ in got] == sorted((a[i] + b[j] for i in range(7) for j in range(5) if i != 2), reverse=True)
    assert len({(i, j) for _, i, j in got}) == 30 and all(s == a[i] + b[j] for s, i, j in got)
    assert list(multi_index.multi_sequence(np.array([-np.inf]), b)) == []


def test_bounds_hold_and_certified_walks_stop_early():
    rows = clustered(3000, 5, width=16, spread=0.05)
    x = np.floor(256 * np.array([v for _, v, _ in rows]))
    books = multi_index.Codebooks(16, x)
    shard = multi_index.Shard(books, np.arange(3000), np.array([y for _, _, y in rows]), x)
    asked = x[::60]
    first, second = shard.half_bounds(asked)
    for cell in range(shard.codes[0] * shard.codes[1]):
        own = shard.vectors[shard.start[cell] : shard.stop[cell]]
        if len(own):
            i, j = divmod(cell, shard.codes[1])
            assert ((asked @ own.T).max(axis=1) <= first[:, i] + second[:, j]).all()
    occupied = int((shard.start < shard.stop).sum())
    n = len(asked)
    found, visited = multi_index.walk(shard, np.arange(3000)[::60], np.array([y for _, _, y in rows])[::60], asked,
                                      np.full((n, 1), -multi_index.ANY), np.full((n, 1), multi_index.ANY), True, 5)
    assert len(found[0]) == 5 * n and visited < 0.6 * n * occupied


def test_small_chunks_change_nothing(monkeypatch):
    rows = clustered(500, 6)
    x, y = np.floor(256 * np.array([v for _, v, _ in rows])), np.array([z for _, _, z in rows])
    shard = multi_index.Shard(multi_index.Codebooks(8, x, 2), np.arange(500), y, x)
    ask = lambda: multi_index.walk(shard, np.arange(0, 500, 9), y[::9], x[::9], np.full((56, 1), -50), np.full((56, 1), 40000), False, 4)
    want = ask()
    monkeypatch.setattr(multi_index, "CHUNK", 50)
    got = ask()
    assert all((a == b).all() for a, b in zip(want[0], got[0]))
