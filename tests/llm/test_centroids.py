"""Clusters against a plain form with Python's integers; Elkan's bounds skip work and lose nothing."""

import hashlib
import math

import numpy as np
import pytest
from conftest import SF

from tidewell.llm import centroids
from tidewell.llm.common import table


def brute(rows, k, rounds, components, scale, salt="2"):
    x = [(i, [math.floor(scale * float(a)) for a in v]) for i, v in rows if v is not None and len(v) == components and all(a is not None and math.isfinite(a) for a in v)]
    far = [i for i, v in x if any(abs(a) >= 1 << 27 for a in v)]
    x = [(i, v) for i, v in x if all(abs(a) < 1 << 27 for a in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest(), np.array(r[1], dtype="<i2" if max(map(abs, r[1])) < 1 << 15 else "<i4").tobytes())
    c = [v for _, v in sorted(x, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in x:
            groups.setdefault(near(v)[1], []).append(v)
        for j, g in groups.items():
            c[j] = [sum(a) // len(g) for a in zip(*g)]
    found = [(i, *near(v)) for i, v in x]
    inertia, total = {}, sum(d for _, d, _ in found)
    for _, d, j in found:
        inertia[j] = inertia.get(j, 0) + d
    return [(i, j, d, inertia[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found] + [(i, *[None] * 5) for i in far]


def order(rows):
    return sorted(map(tuple, rows), key=str)


def test_equals_plain_rounds_on_the_table(spark):
    vectors = table(spark, SF, "embeddings")
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()], 40, 5, 64, 256)
    assert order(centroids.report(vectors).collect()) == order(want)


@pytest.mark.parametrize("k,rounds,scale", [(6, 5, 2), (3, 0, 1), (1, 2, 4), (200, 3, 2)])
def test_ties_and_odd_vectors(spark, k, rounds, scale):
    """Small integers give many ties; rows are repeated, lack ids, or hold what can't take part."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(150)]
    rows += rows[:20] + [(None, [1.0, 1.0, 0.0]), (None, [1.0, 1.0, 0.0]), (900, None), (901, [1.0, None, 2.0]), (902, [1.0, float("nan"), 0.0]), (903, [float("inf"), 0.0, 0.0]), (904, [1.0, 2.0]), (905, []), (906, [-0.3, 0.7, 9000.25]), (907, [1e30, 0.0, 0.0]), (908, [-(2.0**27), 0.0, 1.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cluster int").repartition(4, "vec_id")
    got, _ = centroids.clusters(frame, k=k, rounds=rounds, components=3, scale=scale)
    assert order(got.collect()) == order(brute(rows, k, rounds, 3, scale))
    assert centroids.clusters(frame.limit(0), k=k, components=3)[0].count() == 0


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-(2**26), 2**26, 64)).astype(float).tolist()) for i in range(60)]
    rows += [(100 + i, [x + (j == 7) for j, x in enumerate(rows[i][1])]) for i in range(20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, _ = centroids.clusters(frame, k=8, rounds=3, scale=1)
    assert order(got.collect()) == order(brute(rows, 8, 3, 64, 1))


def test_bounds_hold_and_skip():
    """After each step the bounds enclose the true distances, and on separated groups most distances are skipped."""
    rng = np.random.default_rng(6)
    middles = rng.integers(-3000, 3000, (10, 8))
    x = np.concatenate([m + rng.integers(-40, 40, (50, 8)) for m in middles])
    c = x[rng.permutation(len(x))[:10]].copy()
    own, upper, lower = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf), np.zeros((len(x), 10), dtype=np.float32)
    drift, counts = None, []
    for _ in range(6):
        bounds = centroids.Bounds(c, drift)
        own, upper, lower, seen = bounds.step(x, own, upper, lower)
        counts.append(seen)
        true = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        assert (own == true.argmin(axis=1)).all()
        assert (upper >= np.sqrt(true[np.arange(len(x)), own])).all() and (lower <= np.sqrt(true)).all()
        new = np.array([[int(s) // int((own == j).sum()) for s in x[own == j].sum(axis=0)] if (own == j).any() else c[j].tolist() for j in range(10)])
        drift, c = centroids.above(((new - c) ** 2).sum(axis=1)), new
    assert counts[-1] < len(x) and sum(counts) < 6 * 10 * len(x) / 3
