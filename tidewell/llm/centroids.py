"""Centroid clustering of integer vectors, exact, with Elkan's bounds.

Every vector keeps an upper bound of the distance to its own centroid and a lower one for each centroid. When centroids
have moved, bounds move with them; a centroid is looked at only if neither its lower bound nor half its distance from
the vector's own centroid shows that it is farther. Bounds are floats rounded away from the true distance and pruning is
strict, so a tie is always seen; what is compared are exact integers. The state lies in the shared folder, a table for
each round, which also holds each task's sums by cluster: a round reads and writes the vectors once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, settle

#: Components at or beyond it, either side: a squared distance of 64 of them might not fit in 63 bits.
FAR = 1 << 27


def whole(vectors: DataFrame, components: int, scale: int) -> DataFrame:
    """vec_id and packed: ``floor(scale * x)`` of the vectors of that length without a null or non-finite component.

    Packed integers take two bytes each if all of a vector's fit, else four; null where one is at ``FAR`` or beyond.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.size("embedding") == components).select("vec_id", v.alias("vector")).where(finite)
    schema = T.StructType([rows.schema["vec_id"], T.StructField("packed", T.BinaryType())])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(scale * batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, components))
            most = np.abs(x).max(axis=1, initial=0)
            packed = [None if m >= FAR else row.astype("<i2" if m < 1 << 15 else "<i4").tobytes() for m, row in zip(most.tolist(), x, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed, pa.binary())], names=schema.names)

    return rows.mapInArrow(pack, schema)


def unpacked(column: pa.Array, components: int) -> np.ndarray:
    out = np.empty((len(column), components), dtype=np.int64)
    for i, raw in enumerate(column.to_pylist()):
        out[i] = np.frombuffer(raw, dtype="<i2" if len(raw) == 2 * components else "<i4")
    return out


def above(squared: np.ndarray) -> np.ndarray:
    """Roots of integers, rounded up so far that rounding of the integer and of the root is covered."""
    root = np.sqrt(squared.astype(np.float64))
    return np.nextafter(np.nextafter(root, np.inf), np.inf)


def below(squared: np.ndarray) -> np.ndarray:
    root = np.sqrt(squared.astype(np.float64))
    return np.maximum(np.nextafter(np.nextafter(root, 0), 0), 0)


def _float32_below(x: np.ndarray) -> np.ndarray:
    near = x.astype(np.float32)
    return np.where(near.astype(np.float64) > x, np.nextafter(near, np.float32(-np.inf)), near)


class Bounds:
    """One step of Elkan's method for some vectors at a time, as ``centroids`` are now; they have moved by ``drift``."""

    def __init__(self, centroids: np.ndarray, drift: np.ndarray | None = None) -> None:
        self.c = centroids
        self.drift = np.zeros(len(centroids)) if drift is None else drift
        apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
        self.half = below(apart) / 2
        alone = self.half.copy()
        np.fill_diagonal(alone, np.inf)
        self.nearest = alone.min(axis=1, initial=np.inf)

    def distances(self, x: np.ndarray, j: np.ndarray | int) -> np.ndarray:
        return ((x - self.c[j]) ** 2).sum(axis=1)

    def step(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New own, upper, lower, and how many distances were computed."""
        own = own.copy()
        upper = np.nextafter(upper + self.drift[own], np.inf)
        lower = np.maximum(np.nextafter(lower.astype(np.float64) - self.drift, -np.inf), 0)
        live = np.flatnonzero((upper >= self.nearest[own]) | np.isinf(upper))
        may = (lower[live] <= upper[live, None]) & (self.half[own[live]] <= upper[live, None])
        may[np.arange(len(live)), own[live]] = False
        live = live[may.any(axis=1) | np.isinf(upper[live])]
        seen = len(live)
        best = self.distances(x[live], own[live])
        upper[live] = above(best)
        lower[live, own[live]] = below(best)
        for j in range(len(self.c)):
            u, a = upper[live], own[live]
            at = np.flatnonzero((lower[live, j] <= u) & (self.half[a, j] <= u) & (a != j))
            if not len(at):
                continue
            rows = live[at]
            d = self.distances(x[rows], j)
            seen += len(at)
            lower[rows, j] = below(d)
            better = (d < best[at]) | ((d == best[at]) & (j < own[rows]))
            won, d = at[better], d[better]
            best[won], own[live[won]], upper[live[won]] = d, j, above(d)
        return own, upper, _float32_below(lower), seen


def _state_schema(vec_id: T.StructField) -> T.StructType:
    vectors = [T.StructField("vec_id", vec_id.dataType), T.StructField("packed", T.BinaryType()), T.StructField("cluster", T.IntegerType()), T.StructField("upper", T.DoubleType()), T.StructField("lower", T.BinaryType()), T.StructField("distance", T.LongType())]
    # rows without ``packed``: a task's totals of one cluster
    totals = [T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType())), T.StructField("inertia", T.DecimalType(38, 0))]
    return T.StructType(vectors + totals)


def _assigned(state: DataFrame, centroids: np.ndarray, drift: np.ndarray | None, last: bool) -> DataFrame:
    """A new table of the vectors' states, and of each task's totals by cluster. ``drift`` None: there are no bounds yet."""
    schema, (k, components) = _state_schema(state.schema["vec_id"]), centroids.shape
    arrow = pa.schema([("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.binary()), ("distance", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("inertia", pa.decimal128(38, 0))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(centroids, drift)
        n, sums, inertia = np.zeros(k, dtype=np.int64), np.zeros((k, components), dtype=np.int64), [0] * k
        vec_type = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.num_rows
            x = unpacked(batch.column("packed"), components)
            if drift is None:
                own, upper, lower = np.zeros(rows, dtype=np.int64), np.full(rows, np.inf), np.zeros((rows, k), dtype=np.float32)
            else:
                own = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                upper = batch.column("upper").to_numpy(zero_copy_only=False)
                lower = np.frombuffer(b"".join(batch.column("lower").to_pylist()), dtype="<f4").reshape(rows, k)
            own, upper, lower, _ = bounds.step(x, own, upper, lower)
            n += np.bincount(own, minlength=k)
            vec_type = batch.schema.field("vec_id").type
            none = pa.nulls(rows)
            if last:
                d = bounds.distances(x, own)
                for j, y in zip(own.tolist(), d.tolist(), strict=True):
                    inertia[j] += y
                rest = [none, pa.array(own, pa.int32()), none, none, pa.array(d, pa.int64())]
                kept = pa.array([b""] * rows, pa.binary())
                columns = [batch.column("vec_id"), kept, rest[1], none.cast(pa.float64()), none.cast(pa.binary()), rest[4]]
            else:
                order = np.argsort(own, kind="stable")
                heads = np.flatnonzero(np.concatenate([[True], np.diff(own[order]) != 0]))
                sums[own[order][heads]] += np.add.reduceat(x[order], heads, axis=0)
                flat = lower.astype("<f4").tobytes()
                columns = [batch.column("vec_id"), batch.column("packed"), pa.array(own, pa.int32()), pa.array(upper), pa.array([flat[4 * k * i : 4 * k * (i + 1)] for i in range(rows)], pa.binary()), none.cast(pa.int64())]
            columns += [none.cast(arrow.field(c).type) for c in ("n", "sums", "inertia")]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        if vec_type is not None:
            from decimal import Decimal

            some = np.flatnonzero(n)
            none = pa.nulls(len(some))
            yield pa.RecordBatch.from_arrays(
                [none.cast(vec_type), none.cast(pa.binary()), pa.array(some, pa.int32()), none.cast(pa.float64()), none.cast(pa.binary()), none.cast(pa.int64()), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64())), pa.array([Decimal(inertia[j]) for j in some.tolist()], pa.decimal128(38, 0))],
                names=schema.names,
            )

    return settle(state.mapInArrow(run, schema), "clusters")


def _totals(state: DataFrame, components: int) -> list[Row]:
    """One row for each cluster that has vectors: number, vectors, sums, inertia."""
    wide = "decimal(38,0)"
    sums = [F.sum(F.get("sums", F.lit(i)).cast(wide)).alias(f"s{i}") for i in range(components)]
    return state.where("packed IS NULL").groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), *sums).collect()


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, components: int = 64, scale: int = 256, salt: str = "2") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector, and the final centroids.

    Vectors of another length or with a null or non-finite component take no part. The first centroids are the vectors
    with the smallest hashes of salt and vec_id, and among rows of one vec_id those of the smaller vector; fewer
    vectors than ``k`` give as many centroids. Rows that repeat a vec_id are vectors of their own; those without one are
    clustered too, and start no centroid unless others are wanting. A component of 2^27 or more after scaling could take
    distances beyond a long: such a vector has a row with nulls for its cluster and moves no centroid. An inertia
    beyond a long is null. An empty table gives no row.

    What the driver holds are k centroids and k rows of sums a round.
    """
    kept = settle(whole(vectors.select("vec_id", "embedding"), components, scale), "whole")
    near = kept.where("packed IS NOT NULL")
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = near.orderBy(key.asc_nulls_last(), "packed").limit(k).select("packed").collect()
    far = kept.where("packed IS NULL").select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in RESULT[1:]])
    if not first:
        return far, np.zeros((0, components), dtype=np.int64)
    c = unpacked(pa.array([bytes(r.packed) for r in first], pa.binary()), components)
    state, drift = near, None
    for _ in range(rounds):
        nxt = _assigned(state, c, drift, last=False)
        if state is not near:
            forget(state)
        new = c.copy()
        for r in _totals(nxt, components):
            new[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(components)]
        drift, c = above(((new - c) ** 2).sum(axis=1)), new
        state = nxt.where("packed IS NOT NULL")
    final = _assigned(state, c, drift, last=True)
    if state is not near:
        forget(state)
    inertia = {r.cluster: int(r.inertia) for r in _totals(final, components)}
    fits = lambda v: v if v < 1 << 63 else None
    rows = [(j, fits(v), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for j, v in inertia.items()]
    about = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = final.where("packed IS NOT NULL").select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster")  # k rows
    return out.select("vec_id", *[c for c, _ in RESULT[1:]]).unionByName(far), c


RESULT = [("vec_id", "long"), ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string")]


def report(vectors: DataFrame) -> DataFrame:
    return clusters(vectors)[0]


def sql(k: int = 40, rounds: int = 5, components: int = 64, scale: int = 256, salt: str = "2") -> str:
    """The same rows; each round is two steps of the query."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {components})""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{salt}:' || vec_id), x) - 1)::INT AS j, x FROM v QUALIFY j < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT v.r, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x, min(struct_pack(d := list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, j := c.j)) AS best
  FROM v CROSS JOIN c{i} c GROUP BY v.r)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS x
  FROM (SELECT best.j AS j, p, sum(x[p])::BIGINT AS s, count(*) AS n FROM a{i} CROSS JOIN generate_series(1, {components}) g(p) GROUP BY best.j, p) GROUP BY j) m USING (j))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, a.best.j AS cluster, a.best.d AS distance, sum(a.best.d) OVER (PARTITION BY a.best.j)::BIGINT AS cluster_inertia, sum(a.best.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.best.j = c.j"""


SQL = sql()
