import hashlib
import math
import random

import numpy as np
import pytest

from voicegrain.llm import kmeans


def brute(rows, k=8, rounds=10, dims=64, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    raw = lambda v: b"".join(x.to_bytes(4, "little", signed=True) for x in v).hex()
    mark = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", raw(r[1]))
    centroids = [v for _, v in sorted(kept, key=mark)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda: [min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)) for _, v in kept]
    for _ in range(rounds):
        at = nearest()
        for c in range(len(centroids)):
            if mine := [v for (_, v), a in zip(kept, at) if a == c]:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine)]
    at = nearest()
    d = [far(v, centroids[a]) for (_, v), a in zip(kept, at)]
    inertia = [sum(x for x, a in zip(d, at) if a == c) for c in range(len(centroids))]
    return sorted(((i, a, x, inertia[a], sum(d), hashlib.sha256(",".join(map(str, centroids[a])).encode()).hexdigest()) for (i, _), a, x in zip(kept, at, d)), key=str)


def run(rows, spark, **options):
    docs = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, vec string").repartition(3)
    return sorted([tuple(r) for r in kmeans.clusters(docs, **options).collect()], key=str)


def test_matches_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = sorted([tuple(r) for r in kmeans.clusters(table).collect()], key=str)
    assert got == brute([(r.vec_id, r.embedding) for r in table.collect()])


def test_ties_are_kept(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randrange(-2, 3) / 2 for _ in range(3)]) for i in range(400)]  # few places, many equal distances
    for k, scale in ((8, 2), (30, 2), (5, 1)):
        assert run(rows, spark, k=k, dims=3, scale=scale) == brute(rows, k, 10, 3, scale)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25]), (1, [0.5, -0.25]), (1, [0.1, 0.2]), (None, [1.0, 1.0]), (None, [-3.0, 2.0]), (2, None), (3, []), (4, [1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [100_000.0, -131_072.0]), (9, [1.0, 2.0, 3.0])]
    assert run(rows, spark, dims=2) == brute(rows, dims=2)
    assert run(rows[:3], spark, dims=2) == brute(rows[:3], dims=2)
    assert run(rows[5:7], spark, dims=2) == []
    assert run([], spark, dims=2) == []
    with pytest.raises(Exception, match="squared distances"):
        run([(1, [1e30, 0.0])], spark, dims=2)


def test_bounds_skip_distances_without_a_change():
    rng = np.random.default_rng(3)
    x = (rng.integers(0, 6, (3000, 1)) * 4000 + rng.integers(0, 50, (3000, 4))).astype(np.int64)
    centroids = np.array([x[np.argmin(x[:, 0] // 4000 != g)] for g in range(6)])
    state = assigned = kmeans.assign(x, np.full(len(x), -1, np.int32), np.full(len(x), np.inf), np.zeros((len(x), 6)), centroids)
    moved = np.full(6, 3.0)
    after = kmeans.assign(x, state[0], state[1] + moved[state[0]], np.maximum(state[2] - moved, 0), centroids)
    assert (after[0] == assigned[0]).all() and after[4] < 0.5 * 6 * len(x)
    exact = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (assigned[0] == exact.argmin(axis=1)).all()
