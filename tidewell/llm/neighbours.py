"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table hashes a vector to floor((a . x + b) / w) for several Gaussian a. A query visits its own bucket and those
that differ by one in some hashes, in the order of estimated success: the sum of squared distances from its projections
to the crossed boundaries. What the visited buckets of all tables hold is ranked by exact distance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import running
from .common import join_small, seeded, settle

#: Vectors, and queries, that one cell of a bucket has on average at most; a task holds the vectors and streams the queries.
CELL, QUERIES = 8192, 1 << 18
#: Numbers in the queries that the exact way ships at once.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Tables:
    """``width`` is in units of the median distance of ``sample`` vectors over the square root of 2 (1 for unit vectors at random).

    Fewer hashes, wider buckets, more tables and more probes raise recall and cost; the defaults hold 0.9 where
    neighbours are hardly nearer than other vectors.
    """

    tables: int = 4
    hashes: int = 6
    width: float = 1.6
    probes: int = 240
    seed: int = 11
    sample: int = 1000


def probe_sets(below: np.ndarray, n: int) -> list[list[tuple[int, int]]]:
    """The first ``n`` sets of (hash, step) by estimated success; ``below``: distances to the lower boundaries in widths."""
    moves = sorted([(float(x) ** 2, i, -1) for i, x in enumerate(below)] + [(float(1 - x) ** 2, i, 1) for i, x in enumerate(below)])
    out: list[list[tuple[int, int]]] = [[]]
    heap: list[tuple[float, tuple[int, ...]]] = [(moves[0][0], (0,))] if moves else []
    while heap and len(out) < n:
        cost, chosen = heappop(heap)
        if len({moves[m][1] for m in chosen}) == len(chosen):
            out.append([(moves[m][1], moves[m][2]) for m in chosen])
        last = chosen[-1]
        if last + 1 < len(moves):
            heappush(heap, (cost - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
            heappush(heap, (cost + moves[last + 1][0], (*chosen, last + 1)))
    return out


class Hasher:
    def __init__(self, plan: Tables, dimension: int, scale: float) -> None:
        self.plan, self.width = plan, plan.width * scale
        n = plan.tables * plan.hashes
        u, v = (seeded(f"{name}-{plan.seed}", n * dimension) / 2.0**64 for name in ("radius", "angle"))
        self.a = (np.sqrt(-2 * np.log1p(-u)) * np.cos(2 * np.pi * v)).reshape(plan.tables, plan.hashes, dimension)
        self.b = (seeded(f"offset-{plan.seed}", n) / 2.0**64 * self.width).reshape(plan.tables, plan.hashes)
        self.mix = (seeded(f"mix-{plan.seed}", plan.hashes) | np.uint64(1)).view(np.int64)

    def places(self, vectors: np.ndarray, t: int) -> np.ndarray:
        return (vectors @ self.a[t].T + self.b[t]) / self.width

    def bucket(self, whole: np.ndarray, t: int) -> np.ndarray:
        """A 64-bit name of the hashes' values and the table."""
        return (np.clip(whole, -(2**40), 2**40).astype(np.int64) * self.mix).sum(axis=-1) * np.int64(self.plan.tables) + np.int64(t)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part: not null, no null or non-finite component, not zero. Floats stay floats, all else is doubles."""
    v = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    rows = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where("vector IS NOT NULL")
    return rows.where(finite & some)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query, ids and exact distances of x's rows among which are its k nearest different ids."""
    squares = (x * x).sum(axis=1)
    for begin in range(0, len(q), 256):
        part = q[begin : begin + 256]
        own = (part * part).sum(axis=1)[:, None]
        all_d2 = own + squares - 2 * part @ x.T
        for row, (i, d2) in enumerate(zip(q_ids[begin : begin + 256].tolist(), all_d2, strict=True)):
            d2[x_ids == i] = np.inf
            some, wide = np.arange(len(d2)), k
            while wide < len(d2):  # twice as many until k different ids are in, as ids may be repeated
                last = np.partition(d2, wide - 1)[wide - 1]
                near = np.flatnonzero(d2 <= last + 1e-9 * (own[row, 0] + squares.max())) if np.isfinite(last) else some
                if near is some or len(np.unique(x_ids[near])) >= k:
                    some = near
                    break
                wide *= 2
            some = some[np.isfinite(d2[some])]
            exact = np.sqrt(((x[some] - part[row]) ** 2).sum(axis=1))
            order = np.lexsort((exact, x_ids[some]))
            order = order[np.concatenate([[True], np.diff(x_ids[some][order]) != 0])[: len(order)]]  # an id's nearest row
            best = order[np.lexsort((x_ids[some][order], exact[order]))][:k]
            yield i, x_ids[some][best], exact[best]


RESULT = T.StructType([T.StructField("d", T.IntegerType()), T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def _best(found: list[tuple[int, np.ndarray, np.ndarray]], k: int, d: int | None) -> pa.RecordBatch:
    """Each query's k nearest different ids among what was found for queries of length ``d``."""
    if not found:
        return pa.RecordBatch.from_arrays([pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=RESULT.names)
    q = np.repeat([i for i, _, _ in found], [len(x) for _, x, _ in found])
    ids, score = np.concatenate([x for _, x, _ in found]), np.concatenate([d for _, _, d in found])
    order = np.lexsort((score, ids, q))
    q, ids, score = q[order], ids[order], score[order]
    new = np.concatenate([[True], (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])])[: len(q)]
    q, ids, score = q[new], ids[new], score[new]
    order = np.lexsort((ids, score, q))
    q, ids, score = q[order], ids[order], score[order]
    heads = np.concatenate([[True], q[1:] != q[:-1]])[: len(q)]
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(heads, np.arange(len(q)), 0))
    keep = rank < k
    return pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), d, dtype=np.int32)), pa.array(q[keep].astype(np.int64)), pa.array(ids[keep].astype(np.int64)), pa.array(score[keep].astype(np.float64))], names=RESULT.names)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, float, pa.RecordBatch]]:
    """Rows of each length with its unit of width."""
    d = batch.column("d").to_numpy(zero_copy_only=False)
    for n in np.unique(d).tolist():
        part = batch.filter(pa.array(d == n))
        yield n, part.column("scale")[0].as_py(), part


class Hashers:
    """The functions of each length, made when they are first needed; a few are kept."""

    def __init__(self, plan: Tables) -> None:
        self.plan, self.made = plan, {}

    def of(self, d: int, scale: float) -> Hasher:
        if (d, scale) not in self.made:
            if len(self.made) >= 8:
                self.made.clear()
            self.made[d, scale] = Hasher(self.plan, d, scale)
        return self.made[d, scale]


def _candidates(rows: DataFrame, queries: DataFrame, plan: Tables, k: int) -> DataFrame:
    """``rows`` and ``queries`` have n (a row's own number), vec_id, vector, d (length) and scale. A bucket belongs to one length.

    A large bucket is a grid of cells, parts of its vectors by blocks of its queries, so that neither side of a hot one
    comes to one task.
    """
    placed = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("d", T.IntegerType()), T.StructField("query", T.BooleanType()), T.StructField("n", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("vector", rows.schema["vector"].dataType)])

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = Hashers(plan)
        for batch in batches:
            for d, scale, part in _by_length(batch):
                x, hasher = _matrix(part.column("vector")), hashers.of(d, scale)
                for t in range(plan.tables):
                    yield pa.RecordBatch.from_arrays([pa.array(hasher.bucket(np.floor(hasher.places(x, t)), t)), part.column("d"), pa.array(np.zeros(len(x), dtype=bool)), *[part.column(c) for c in ("n", "vec_id", "vector")]], names=placed.names)

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = Hashers(plan)
        for batch in batches:
            for d, scale, part in _by_length(batch):
                hasher = hashers.of(d, scale)
                for row in range(part.num_rows):
                    one = part.slice(row, 1)
                    x = _matrix(one.column("vector"))
                    for t in range(plan.tables):
                        place = hasher.places(x, t)[0]
                        whole = np.floor(place)
                        sets = probe_sets(place - whole, plan.probes)
                        at = np.tile(whole, (len(sets), 1))
                        for s, chosen in enumerate(sets):
                            for i, step in chosen:
                                at[s, i] += step
                        names = np.unique(hasher.bucket(at, t))
                        same = pa.array(np.zeros(len(names), dtype=np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(names), one.column("d").take(same), pa.array(np.ones(len(names), dtype=bool)), *[one.column(c).take(same) for c in ("n", "vec_id", "vector")]], names=placed.names)

    stored, probes = rows.mapInArrow(index, placed), queries.mapInArrow(probe, placed)
    kinds = stored.select("bucket", "d", "query").unionByName(probes.select("bucket", "d", "query"))
    counts = kinds.groupBy("bucket", "d").agg(F.count_if(~F.col("query")).alias("rows"), F.count_if("query").alias("asked"))
    grid = counts.select("bucket", "d", F.ceil(F.col("rows") / CELL).cast("int").alias("parts"), F.ceil(F.col("asked") / QUERIES).cast("int").alias("blocks"))
    large = settle(grid.where("parts > 1 OR blocks > 1"), "buckets")
    parts, blocks = F.greatest(F.coalesce("parts", F.lit(1)), F.lit(1)), F.greatest(F.coalesce("blocks", F.lit(1)), F.lit(1))
    own = lambda n: F.pmod(F.xxhash64("n"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    a = join_small(stored, large, ["bucket", "d"], "left").withColumn("part", own(parts)).withColumn("block", every(blocks))
    b = join_small(probes, large, ["bucket", "d"], "left").withColumn("part", every(parts)).withColumn("block", own(blocks))
    cells = ["bucket", "d", "part", "block"]
    both = a.unionByName(b).select(*cells, "query", "vec_id", "vector")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        kept, length = 0, None
        for d, q, q_ids, x, x_ids in _cells(batches):
            if d != length or kept > 500_000:
                best = _best(found, k, length)
                found, kept = _split(best), best.num_rows
                if d != length or kept > 250_000:
                    yield best
                    found, kept = [], 0
                length = d
            for hit in _nearest(q, q_ids, x, x_ids, k):
                found.append(hit)
                kept += len(hit[1])
        yield _best(found, k, length)

    return both.repartition(*cells).sortWithinPartitions("d", "bucket", "part", "block", "query").mapInArrow(search, RESULT)


def _split(best: pa.RecordBatch) -> list[tuple[int, np.ndarray, np.ndarray]]:
    q, ids, score = [c.to_numpy(zero_copy_only=False) for c in best.columns[1:]]
    at = np.concatenate([[0], np.flatnonzero(q[1:] != q[:-1]) + 1]) if len(q) else np.zeros(0, dtype=np.int64)
    return list(zip(q[at].tolist(), np.split(ids, at[1:]), np.split(score, at[1:]), strict=True)) if len(q) else []


def _cells(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of sorted rows, in which a cell's vectors come before its queries: length, some of a cell's queries, its vectors. The queries are not held."""
    key, held, whole = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bucket", "d", "part", "block", "query")])
        at = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            now, query = tuple(keys[:4, a].tolist()), bool(keys[4, a])
            if now != key:
                key, held, whole = now, [], None
            part = batch.slice(a, b - a)
            ids, x = part.column("vec_id").to_numpy(zero_copy_only=False), _matrix(part.column("vector"))
            if not query:
                held.append((ids, x))
            elif held:
                if whole is None:
                    whole = (np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held]))
                yield now[1], x, ids, whole[1], whole[0]


def _exact(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """All rows against queries in blocks of bounded size: each block goes to the tasks, which keep its k nearest of their rows."""
    out = None
    marked = running(queries, [F.col("d"), F.col("n")], {"before": "d"}, "place")
    marked = settle(marked.withColumn("block", F.floor(F.col("before") / BLOCK)), "late")
    for block in [r.block for r in marked.select("block").distinct().orderBy("block").collect()]:
        some: dict[int, tuple[list, list]] = {}
        for r in marked.where(F.col("block") == block).select("d", "vec_id", "vector").toLocalIterator():
            ids, vectors = some.setdefault(r.d, ([], []))
            ids.append(r.vec_id)
            vectors.append(r.vector)
        shipped = rows.sparkSession.sparkContext.broadcast({d: (np.array(ids), np.array(vectors)) for d, (ids, vectors) in some.items()})

        def search(batches: Iterable[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            found: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
            for batch in batches:
                for d, _, part in _by_length(batch):
                    if d in shipped.value:
                        ids, q = shipped.value[d]
                        hits = found.get(d, []) + list(_nearest(q, ids, _matrix(part.column("vector")), part.column("vec_id").to_numpy(zero_copy_only=False), k))
                        found[d] = _split(_best(hits, k, d))
            for d, hits in found.items():
                yield _best(hits, k, d)

        part = rows.where(F.col("d").isin(*some)).mapInArrow(search, RESULT)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], RESULT)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("d", "query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("d", "query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scales(rows: DataFrame, sample: int) -> DataFrame:
    """d, scale: the median distance over the square root of 2 among some ``sample`` vectors of each length, 1 where all are equal."""
    lengths = settle(rows.groupBy("d").agg(F.count(F.lit(1)).alias("_all")), "lengths")
    some = join_small(rows, lengths, "d", "inner").where(F.pmod(F.xxhash64("n"), F.ceil(F.col("_all") / sample)) == 0).select("d", "n", "vector")

    def scale(key: tuple, some) -> object:  # pandas; about ``sample`` rows
        import pandas as pd

        x = np.stack(some.sort_values("n")["vector"].to_numpy()).astype(np.float64)
        half = len(x) // 2
        apart = np.sqrt(((x[:half] - x[half : 2 * half]) ** 2).sum(axis=1))
        apart = apart[apart > 0]
        return pd.DataFrame({"d": [key[0]], "scale": [float(np.median(apart)) / 2**0.5 if len(apart) else 1.0]})

    found = some.groupBy("d").applyInPandas(scale, "d int, scale double")
    return settle(lengths.select("d").join(found, "d", "left").select("d", F.coalesce("scale", F.lit(1.0)).alias("scale")), "scales")


def search(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, plan: Tables = Tables()) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest found by Euclidean distance, ties to the smaller vec_id.

    ``vectors`` and ``queries`` have vec_id and embedding; without ``queries`` those are the vectors whose vec_id is
    divisible by 100. Candidates are all vectors of another vec_id and the query's length; rows that repeat a vec_id
    count once, at their smallest distance. A query whose buckets hold fewer than ``k`` is compared with all rows, in
    blocks, so that it gets ``k`` or all there are. Null, zero and non-finite vectors take no part. The length belongs to
    a bucket's name, and each length has its own functions; there may be any number of lengths.
    """
    own = queries is None
    both = [usable(vectors)] if own else [usable(vectors), usable(queries)]
    if len({df.schema["vector"].dataType.elementType for df in both}) > 1:  # nothing is rounded to the other's type
        both = [df.withColumn("vector", F.col("vector").cast("array<double>")) for df in both]
    both = [df.withColumn("d", F.size("vector")).withColumn("n", F.monotonically_increasing_id()) for df in both]
    rows = settle(both[0], "vectors")
    asked = rows.where(F.col("vec_id") % 100 == 0) if own else settle(both[1], "queries")
    scales = _scales(rows, plan.sample)
    rows, asked = join_small(rows, scales, "d", "inner"), join_small(asked, scales, "d", "inner")
    found = settle(_ranked(_candidates(rows, asked, plan, k), k), "found")
    most = settle(rows.groupBy("d").agg((F.countDistinct("vec_id") - (1 if own else 0)).alias("most")), "most")
    wanted = join_small(asked.select("d", "vec_id").distinct(), most, "d", "inner")
    full = found.groupBy("d", F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n_found"))
    few = wanted.join(full, ["d", "vec_id"], "left").where(F.coalesce("n_found", F.lit(0)) < F.least(F.lit(k), F.col("most"))).select("d", "vec_id")
    late = settle(asked.join(few, ["d", "vec_id"], "left_semi"), "few")
    if not late.isEmpty():
        again = _ranked(_exact(rows, late, k), k)
        found = found.join(late.select("d", F.col("vec_id").alias("query_id")).distinct(), ["d", "query_id"], "left_anti").unionByName(again, allowMissingColumns=True)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def report(vectors: DataFrame) -> DataFrame:
    """``search`` of a table's own vectors: a null vec_id or vector takes no part, rows of one vec_id count once, an empty table gives no row, further columns are not read."""
    return search(vectors.select("vec_id", "embedding"))
