"""Near duplicates by SimHash fingerprints: bit-sliced comparison within cells, then the texts' own similarity.

Texts of equal sets of shingles are one node. A node stands in ANCHORS cells, one for the least of its shingles' hashes
by each of as many orders: two sets of similarity s share a cell with probability 1 - (1 - s) ** ANCHORS, at any number
of documents. In a cell fingerprints stand as bit planes, distances of many pairs are counted at once and given up
where all exceed the radius. A pair within it is looked at in the first cell that its texts share, and links if their
sets of shingles are alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from ..plans.components import components
from .common import forget, join_small, seeded, settle
from .simhash import EDGE, Plan, _planes, cut, fingerprint_of, shingle_hashes, within

#: Two sets of 0.8 similarity differ in 15 of 100 bits on average, in 39 ± 5.7 of 256: one in 100,000 lies beyond 64.
PRINTS = Plan(shingle=5, radius=64, bits=256, once=True)
#: Jaccard similarity of linked texts' sets of shingles.
ALIKE = 0.8
#: Orders of hashes. A pair of 0.8 shares no cell with probability 0.2 ** 8, about 3 in a million.
ANCHORS = 8
#: Nodes, and bytes of shingles' hashes, of one part of a cell; parts of a larger cell meet pairwise.
CELL, SETS = 512, 4 << 20
_MIX = seeded("near-copies", 2 * ANCHORS) | np.uint64(1)
_PRINT, _ANCHOR = PRINTS.columns, [f"a{t}" for t in range(ANCHORS)]
_LONG = lambda names: [T.StructField(c, T.LongType()) for c in names]
_DIGEST = ["d0", "d1"]
_NODE = ["node", *_DIGEST, *_PRINT, *_ANCHOR]


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, PRINTS.shingle))


def anchors(h: np.ndarray) -> np.ndarray:
    """The least of the hashes in each order; of no hashes all are zero."""
    if not len(h):
        return np.zeros(ANCHORS, dtype=np.uint64)
    out = np.empty(ANCHORS, dtype=np.uint64)
    for t in range(ANCHORS):
        x = (h ^ _MIX[2 * t]) * _MIX[2 * t + 1]
        out[t] = ((x ^ x >> np.uint64(32)) * _MIX[2 * t]).min()
    return out


def digest(h: np.ndarray) -> np.ndarray:
    return np.frombuffer(xxh3_128_digest(h.tobytes()), dtype=np.uint64)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the set of shingles, fingerprint and anchors of every whole text (null: empty)."""
    columns = ["doc_id", *_DIGEST, *_PRINT, *_ANCHOR]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingle_set(x.as_py()) for x in batch.column("text"))
            rows = np.array([np.concatenate([digest(h), fingerprint_of(h, PRINTS), anchors(h)]) for h in sets], dtype=np.uint64).reshape(batch.num_rows, len(columns) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in rows.T]], names=columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, T.StructType(_LONG(columns)))


def _cells(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[list[pa.ChunkedArray]]:
    """Sorted rows as tables of whole cells, several small ones or one large one; the first ``n`` columns name the cell."""
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        if not now.num_rows:
            continue
        key = np.column_stack([c.to_numpy() for c in now.columns[:n]])
        last = np.flatnonzero((key != key[-1]).any(axis=1))
        whole = int(last[-1]) + 1 if len(last) else 0
        if whole:
            yield now.slice(0, whole)
        rest = now.slice(whole)
    if rest is not None and rest.num_rows:
        yield rest


def _numbers(rows: pa.Table, names: list[str]) -> np.ndarray:
    return np.column_stack([rows.column(c).to_numpy().astype(np.int64) for c in names])


def _anchored(reps: DataFrame) -> DataFrame:
    """Each node in its cells (t, anchor)."""
    cells = F.array(*[F.struct(F.lit(t).alias("t"), F.col(c).alias("anchor")) for t, c in enumerate(_ANCHOR)])
    return reps.select(F.explode(cells).alias("_c"), *_NODE).select("_c.t", "_c.anchor", *_NODE)


def members(reps: DataFrame) -> DataFrame:
    """Rows (t, anchor, node, ...) of those nodes that have a pair within the radius in the cell, one not met in an earlier cell."""
    schema = T.StructType([T.StructField("t", T.IntegerType()), *_LONG(["anchor", *_NODE])])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(batches, 4):
            key = _numbers(rows, ["t", "anchor", "i", "j"])
            found = near_members(key, _numbers(rows, ["own"])[:, 0], _numbers(rows, _PRINT).view(np.uint64), _numbers(rows, _ANCHOR))
            if found.any():
                yield from rows.filter(pa.array(found)).select(schema.names).to_batches()

    keyed = cut(_anchored(reps), ["t", "anchor"], F.count(F.lit(1)) / CELL, F.xxhash64(*_DIGEST), keep_own=True)
    return keyed.select("t", "anchor", "i", "j", "own", *_NODE).mapInArrow(compare, schema).distinct()


def _open(key: np.ndarray, own: np.ndarray, anchor: np.ndarray, a, b) -> np.ndarray:
    """Which pairs of rows a, b of one cell are to be compared in it: parts i and j meet there, and no earlier order has the pair."""
    across = (key[a, 2] == key[a, 3]) | (own[a] != own[b])
    return across & ~((anchor[a] == anchor[b]) & (np.arange(ANCHORS) < key[a, :1])).any(axis=1)


def near_members(key: np.ndarray, own: np.ndarray, prints: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Of rows sorted by cell (``key``: t, anchor, i, j), those with a pair to compare within the radius."""
    n = len(key)
    out = np.zeros(n, dtype=bool)
    heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
    sizes = np.diff(np.append(heads, n))
    cell, of_row = np.repeat(np.arange(len(heads)), sizes), np.repeat(sizes, sizes)
    low = 1
    while low < sizes.max(initial=0):  # small cells side by side, larger ones at larger shifts
        rows = np.flatnonzero(of_row > low)
        planes = _planes(prints[rows])
        for shift in range(low, min(4 * low, int(of_row[rows].max()))):
            a, b = rows[:-shift], rows[shift:]
            same = cell[a] == cell[b]
            same[same] = _open(key, own, anchor, a[same], b[same])
            if same.any():
                near = within(planes, shift, int.from_bytes(np.packbits(same, bitorder="little").tobytes(), "little"), PRINTS.radius)
                if near:
                    at = np.flatnonzero(np.unpackbits(np.frombuffer(near.to_bytes(len(rows) // 8 + 1, "little"), dtype=np.uint8), bitorder="little"))
                    out[a[at]] = out[b[at]] = True
        low *= 4
    return out


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """d0, d1, and the hashes of the shingles (binary, sorted) of the texts of ``nodes``."""
    some = settle(nodes.select(F.col("node").alias("doc_id")).distinct(), "asked")
    texts = join_small(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), some, "doc_id", "left_semi", max_rows=500_000, max_bytes=4 << 20)
    schema = T.StructType([*_LONG(_DIGEST), T.StructField("hashes", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                sets = [shingle_set(x.as_py()) for x in batch.column("text").slice(begin, 64)]
                d = np.array([digest(h) for h in sets], dtype=np.uint64).view(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1])), pa.array([h.tobytes() for h in sets], pa.binary())], names=schema.names)

    # rows that repeat a doc_id give a set twice, or one that isn't asked for, which no member joins
    return texts.mapInArrow(run, schema).dropDuplicates(_DIGEST)


def alike_pairs(own: np.ndarray, key: np.ndarray, prints: np.ndarray, anchor: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of rows of one cell that span its links: within the radius and of ALIKE similarity; connected ones aren't asked again."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True) if sizes.sum() else (None, np.zeros(0, dtype=np.int64))
    starts = np.cumsum(sizes) - sizes
    flag = np.zeros(int(code.max(initial=-1)) + 1, dtype=bool)
    planes, full = _planes(prints), (1 << n) - 1
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    label, out = np.arange(n), []
    for a in range(n - 1):
        later = np.arange(a + 1, n)
        asked = np.zeros(n, dtype=bool)
        asked[a + 1 :] = (label[a + 1 :] != label[a]) & _open(key, own, anchor, np.full(len(later), a), later)
        if not asked.any():
            continue
        wanted = int.from_bytes(np.packbits(asked, bitorder="little").tobytes(), "little")
        near = within([p ^ full if bit else p for p, bit in zip(planes, bits[a].tolist(), strict=True)], 0, wanted, PRINTS.radius, apart=False)
        if not near:
            continue
        b = np.flatnonzero(np.unpackbits(np.frombuffer(near.to_bytes(n // 8 + 1, "little"), dtype=np.uint8), bitorder="little"))
        mine = code[starts[a] : starts[a] + sizes[a]]
        flag[mine] = True
        for part in np.array_split(b, int(sizes[b].sum()) // 1_000_000 + 1):
            at = np.repeat(starts[part] - (np.cumsum(sizes[part]) - sizes[part]), sizes[part]) + np.arange(int(sizes[part].sum()))
            hits = np.concatenate([[0], np.cumsum(flag[code[at]])])
            ends = np.cumsum(sizes[part])
            both = hits[ends] - hits[ends - sizes[part]]
            for x in part[both >= ALIKE * (sizes[a] + sizes[part] - both) - 1e-9].tolist():
                if label[x] != label[a]:
                    out.append((a, x))
                    label[label == label[x]] = label[a]
        flag[mine] = False
    return out


def links(found: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges a, b between nodes of alike texts, which connect all linked ones."""
    whole = found.join(sets, _DIGEST)
    parts = F.greatest(F.count(F.lit(1)) / CELL, F.sum(F.octet_length("hashes")) / SETS)
    keyed = cut(whole.select("t", "anchor", *_NODE, "hashes"), ["t", "anchor"], parts, F.xxhash64(*_DIGEST), keep_own=True).select("t", "anchor", "i", "j", "own", *_NODE, "hashes")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(batches, 4):
            key, own, prints, anchor, node = _numbers(rows, ["t", "anchor", "i", "j"]), _numbers(rows, ["own"])[:, 0], _numbers(rows, _PRINT).view(np.uint64), _numbers(rows, _ANCHOR), rows.column("node").to_numpy()
            hashes = rows.column("hashes")
            edges = []
            heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))
            for begin, end in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
                if end - begin > 1:
                    sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in hashes.slice(begin, end - begin)]
                    cell = slice(begin, end)
                    edges += [(node[begin + a], node[begin + b]) for a, b in alike_pairs(own[cell], key[cell], prints[cell], anchor[cell], sets)]
            if edges:
                pairs = np.array(edges, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=EDGE.names)

    return keyed.mapInArrow(compare, EDGE).distinct()


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Descriptions by row, nodes, and the linked nodes' components; all three are settled."""
    own = settle(described(docs), "described")
    first = F.min(F.struct("doc_id", *_PRINT, *_ANCHOR)).alias("_r")
    reps = settle(own.where("doc_id IS NOT NULL").groupBy(*_DIGEST).agg(first).select(*_DIGEST, F.col("_r.doc_id").alias("node"), *[F.col(f"_r.{c}") for c in (*_PRINT, *_ANCHOR)]).select(*_NODE), "nodes")
    found = settle(members(reps), "members")
    sets = settle(sets_of(docs, found), "sets")
    classes = settle(components(links(found, sets)), "classes")
    forget(found, sets)
    return own, reps, classes


def groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id and component_id, the smallest doc_id that links reach, the document's own included.

    Texts link at ALIKE similarity or more of their sets of shingles; texts without words (null, empty, white space)
    are all alike. Rows that repeat a doc_id are one document, which links what any of its texts links. A row whose
    doc_id is null links nothing; its component_id is that of an equal text, if there is one. Further columns,
    whatever their names, are not read.
    """
    own, reps, classes = _classes(docs)
    named = reps.join(classes, "node", "left").select(*_DIGEST, F.coalesce("component", "node").alias("component_id"))
    return own.join(named, _DIGEST, "left").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the document of the smallest doc_id stays.

    Rows that repeat a doc_id are one document, of which one row stays; rows without a doc_id all stay. Columns of any
    name are kept as they are.
    """
    own, reps, classes = _classes(docs)
    kept = settle(reps.select("node").distinct().join(classes.where("component < node"), "node", "left_anti").select(F.col("node").alias("_kept")), "kept")
    forget(own, reps, classes)
    row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text"))
    one = Window.partitionBy("_id").orderBy("_text")
    named = row.where("_id IS NOT NULL").join(kept, F.col("_id") == F.col("_kept"), "left_semi").withColumn("_n", F.row_number().over(one)).where("_n = 1")
    return named.select("_row.*").unionByName(docs.where("doc_id IS NULL"))
