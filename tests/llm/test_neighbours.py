import itertools

import numpy as np
import pytest
from conftest import SF

from tidewell.llm import neighbours
from tidewell.llm.common import table


def brute(rows, k=10):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    out = {}
    for i, v in good:
        if i % 100 == 0:
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            best = {}
            for j, e in zip(ids.tolist(), d.tolist(), strict=True):
                if j != i:
                    best[j] = min(e, best.get(j, e))
            out[i] = sorted((e, j) for j, e in best.items())[:k]
    return out


def test_probe_order_is_by_cost():
    below = np.array([0.1, 0.45, 0.8])
    sets = neighbours.probe_sets(below, 27)
    cost = lambda s: sum(below[i] ** 2 if d < 0 else (1 - below[i]) ** 2 for i, d in s)
    want = [[(i, d) for i, d in enumerate(x) if d] for x in itertools.product((-1, 0, 1), repeat=3)]
    assert len(sets) == 27 and [round(cost(s), 9) for s in sets] == sorted(round(cost(s), 9) for s in want)


def test_recall_and_scores(spark):
    for path in (SF, "/root/testdata/sf0.1"):
        vectors = table(spark, path, "embeddings")
        want = brute([(r.vec_id, r.embedding) for r in vectors.collect()])
        got = {}
        for r in sorted(neighbours.report(vectors).collect()):
            got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert got.keys() == want.keys() and all(len(v) == 10 and v == sorted(v) for v in got.values())
        hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
        assert hits >= 0.9 * sum(map(len, want.values()))
        exact = {(q, j): e for q in want for e, j in want[q]}
        assert all(abs(e - exact[q, j]) < 1e-12 for q in got for e, j in got[q] if (q, j) in exact)


@pytest.mark.parametrize("cell", [8192, 4])
def test_odd_vectors(spark, monkeypatch, cell):
    monkeypatch.setattr(neighbours, "CELL", cell)
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [-50.0, 3.0]), (8, [1.0, 2.0, 3.0]), (200, None), (300, [0.0, 0.0]), (None, [1.0, 1.0]), (9, [1.0, 0.5])]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, score int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.report(frame).collect())
    want = brute([r for r in rows if r[0] is not None and (r[1] is None or len(r[1]) == 2)])
    assert got == sorted((q, n + 1, j, pytest.approx(e)) for q, v in want.items() for n, (e, j) in enumerate(v))
    assert neighbours.report(frame.limit(0)).count() == 0


def test_repeated_rows_count_once(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(100, 130)]
    rows += [(1, [v + 1e-3 for v in rows[0][1]])] * 100 + [(2, (np.array(rows[0][1]) + 1e-3 * rng.normal(size=4)).tolist()) for _ in range(100)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(frame).collect())
    want = brute(rows)
    assert got == sorted((q, n + 1, j, pytest.approx(e)) for q, v in want.items() for n, (e, j) in enumerate(v)) and len(got) == 10
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    found = next(neighbours._nearest(x[:1], ids[:1], x, ids, 10))
    assert found[1].tolist() == [j for _, j in want[100]]


def test_each_length_has_its_own_candidates(spark):
    rng = np.random.default_rng(8)
    rows = [(100 * i, rng.normal(size=3 + i % 2).tolist()) for i in range(6)] + [(i, rng.normal(size=3 + i % 2).tolist()) for i in range(1, 30)] + [(600, [1.0])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    want = {}
    for d in (1, 3, 4):
        want |= brute([r for r in rows if len(r[1]) == d])
    assert got == sorted((q, n + 1, j, pytest.approx(e)) for q, v in want.items() for n, (e, j) in enumerate(v))


def test_any_number_of_lengths(spark):
    """Thirty lengths, a few vectors each, so that some queries have fewer than k candidates."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=1 + i % 30).tolist()) for i in range(1, 400)] + [(100 * i, rng.normal(size=1 + i % 30).tolist()) for i in range(4, 64)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect())
    want = {}
    for d in range(1, 31):
        want |= brute([r for r in rows if len(r[1]) == d], 5)
    assert [(q, n) for q, n, _, _ in got] == sorted((q, n + 1) for q, v in want.items() for n in range(len(v)))
    at = dict(rows)
    assert all(e == pytest.approx(np.linalg.norm(np.array(at[q]) - at[j])) for q, _, j, e in got)
    assert len({(q, j) for q, _, j, _ in got} & {(q, j) for q, v in want.items() for _, j in v}) >= 0.97 * len(got)


def test_hot_bucket_on_both_sides(spark, monkeypatch):
    """Vectors and queries all but equal, rows that repeat one vec_id among them: cells of 50 vectors and 128 queries."""
    monkeypatch.setattr(neighbours, "CELL", 50)
    monkeypatch.setattr(neighbours, "QUERIES", 128)
    rng = np.random.default_rng(10)
    rows = [(i, (1 + 1e-6 * rng.normal(size=3)).tolist()) for i in range(300)] + [(7, (1 + 1e-6 * rng.normal(size=3)).tolist()) for _ in range(200)]
    asked = [(10_000 + i, (1 + 1e-6 * rng.normal(size=3)).tolist()) for i in range(1500)]
    frame = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in sorted(neighbours.search(frame(rows), frame(asked), k=4).collect()):
        got.setdefault(r.query_id, []).append(r.vec_id)
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    for q, v in asked:
        best = {}
        for j, e in zip(ids.tolist(), ((x - v) ** 2).sum(axis=1).tolist(), strict=True):
            best[j] = min(e, best.get(j, e))
        assert got[q] == sorted(best, key=lambda j: (best[j], j))[:4]


def test_queries_of_a_cell_are_not_held():
    """A cell's queries come out batch by batch, with the cell's vectors whole."""
    import pyarrow as pa

    def batch(bucket, query, ids):
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array([bucket] * n), pa.array([2] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array([query] * n), pa.array(ids), pa.array([[float(i), 0.0] for i in ids])], names=["bucket", "d", "part", "block", "query", "vec_id", "vector"])

    seen = [(d, q_ids.tolist(), x_ids.tolist()) for d, _, q_ids, _, x_ids in neighbours._cells([batch(1, False, [1, 2]), batch(1, False, [3]), batch(1, True, [9, 8]), batch(1, True, [7]), batch(2, True, [6]), batch(3, False, [5]), batch(4, False, [4]), batch(4, True, [3])])]
    assert seen == [(2, [9, 8], [1, 2, 3]), (2, [7], [1, 2, 3]), (2, [3], [4])]


def test_given_queries_keep_their_precision(spark):
    rows = spark.createDataFrame([(i, [0.1 * i, 1.0]) for i in range(12)], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [0.123456789012, 1.0])], "vec_id long, embedding array<double>")
    got = neighbours.search(rows, asked, k=3).orderBy("rank").collect()
    x = [float(np.float32(0.1 * i)) for i in range(12)]
    want = sorted((abs(v - 0.123456789012), i) for i, v in enumerate(x) if i != 1)[:3]
    assert [(r.score, r.vec_id) for r in got] == [(pytest.approx(e, abs=1e-15), i) for e, i in want]
