"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison.

Fingerprints that share a key (some of their bits) meet in a cell. Within a cell they stand vertically, one big integer
per bit; a fingerprint is compared with the one d places on by shifting the planes. Distances of all pairs are counted
at once by carry-save adders that overflow past the radius, and a comparison ends when every pair has overflowed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import join_small, settle
from ..plans.components import components

SEED = 42
#: Fingerprints that one cell compares at most; a larger cell is cut into parts that meet pairwise.
CELL = 2048
EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


@dataclass(frozen=True)
class Plan:
    """How fingerprints are made and linked.

    ``bits`` is 64 or a multiple; with ``once`` a text's different shingles count once each. Fingerprints link at
    ``radius`` or fewer differing bits.
    """

    shingle: int = 3
    radius: int = 3
    bits: int = 64
    once: bool = False

    @property
    def columns(self) -> list[str]:
        return [f"f{i}" for i in range(self.bits // 64)]

    def keys(self, n: int) -> list[list[int]]:
        """The bits of each key, for ``n`` fingerprints.

        The bits are cut into blocks, more than ``radius``, and every choice of blocks that leaves out ``radius`` of
        them is a key: one is equal in any linked pair, so that no link is lost. Blocks get smaller with the number of
        fingerprints, up to 35 keys at radius 3, so that cells stay small.
        """
        blocks = self.radius + 1
        while n >> self.bits * (blocks - self.radius) // blocks > 256 and blocks < self.radius + 4:
            blocks += 1
        edges = [self.bits * i // blocks for i in range(blocks + 1)]
        return [[b for i in chosen for b in range(edges[i], edges[i + 1])] for chosen in combinations(range(blocks), blocks - self.radius)]


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, A-Z lower-cased; of the whole if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: len(words) - shingle]]]
    return np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=True)), dtype=np.uint64, count=len(starts))


def fingerprint(text: str | None, plan: Plan = Plan()) -> np.ndarray:
    """The fingerprint's 64-bit words, lowest first; a bit is 1 if it is set in over half the hashes."""
    h = shingle_hashes(text, plan.shingle)
    return fingerprint_of(np.unique(h) if plan.once else h, plan)


def fingerprint_of(h: np.ndarray, plan: Plan = Plan()) -> np.ndarray:
    """The fingerprint of shingles' hashes."""
    out = np.zeros(plan.bits // 64, dtype=np.uint64)
    for i in range(len(out) if len(h) else 0):
        if i:  # further words: a finaliser's mix of the hash and the word's number
            h = (h ^ (h >> np.uint64(31)) ^ np.uint64(i)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        counts = np.zeros(64, dtype=np.int64)
        for part in np.array_split(h, len(h) // 4096 + 1):
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id and the fingerprint as 64-bit integers f0, f1 and so on, for every whole text (null: empty)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in plan.columns]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([fingerprint(x.as_py(), plan) for x in batch.column("text")], dtype=np.uint64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(rows[:, i].view(np.int64) if rows.shape[1] == 1 else np.ascontiguousarray(rows[:, i]).view(np.int64)) for i in range(rows.shape[1])]], names=schema.names)

    return docs.mapInArrow(run, schema)


def _planes(words: np.ndarray) -> list[int]:
    """Bit b of all fingerprints as one integer; the fingerprint of row i is at bit i."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
    return [int.from_bytes(x.tobytes(), "little") for x in np.packbits(bits.T, axis=1, bitorder="little")]


def within(planes: list[int], shift: int, wanted: int, radius: int, apart: bool = True) -> int:
    """The rows among ``wanted`` that differ from the row ``shift`` on in ``radius`` bits at most.

    Without ``apart`` the planes are differences already, of all rows from a given one.
    """
    width = radius.bit_length()
    spare = (1 << width) - 1 - radius  # preset so that radius + 1 differences overflow
    counter = [wanted if spare >> j & 1 else 0 for j in range(width)]
    over = 0
    for k in range(0, len(planes), 2):
        x = (planes[k] ^ planes[k] >> shift if apart else planes[k]) & wanted
        y = (planes[k + 1] ^ planes[k + 1] >> shift if apart else planes[k + 1]) & wanted
        if not width:
            over |= x | y
        else:
            low = counter[0]
            half = low ^ x
            counter[0], carry = half ^ y, low & x | half & y  # a carry-save adder takes two planes at once
            for j in range(1, width):
                counter[j], carry = counter[j] ^ carry, counter[j] & carry
            over |= carry
        if k % 8 == 6 and over == wanted:
            return 0
    return wanted & ~over


def cell_links(groups: np.ndarray, words: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Rows sorted by group to pairs of rows that span each group's links: a forest, not all pairs."""
    out: list[tuple[int, int]] = []
    heads = np.flatnonzero(np.diff(groups, prepend=groups[:1] - 1)) if len(groups) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(heads, len(groups)))
    label = np.arange(len(groups))

    def compare(rows: np.ndarray, low: int, high: int) -> None:
        planes, own = _planes(words[rows]), groups[rows]
        for shift in range(low, min(high, len(rows))):
            same = (own[:-shift] == own[shift:]) & (label[rows[:-shift]] != label[rows[shift:]])
            if not same.any():
                continue
            near = within(planes, shift, int.from_bytes(np.packbits(same, bitorder="little").tobytes(), "little"), radius)
            if near:
                found = np.flatnonzero(np.unpackbits(np.frombuffer(near.to_bytes(len(rows) // 8 + 1, "little"), dtype=np.uint8), bitorder="little"))
                for a, b in zip(rows[found].tolist(), rows[found + shift].tolist(), strict=True):
                    if (old := label[b]) != label[a]:
                        out.append((a, b))
                        begin = np.searchsorted(heads, a, side="right") - 1
                        part = label[heads[begin] : heads[begin] + sizes[begin]]
                        part[part == old] = label[a]

    of_row = np.repeat(sizes, sizes)
    for low, high in ((1, 8), (8, 64), (64, 512)):
        rows = np.flatnonzero(of_row > low)
        if len(rows):
            compare(rows, low, high)
    for head, size in zip(heads.tolist(), sizes.tolist(), strict=True):
        if size > 512:
            compare(np.arange(head, head + size), 512, size)
    return out


def links(reps: DataFrame, plan: Plan) -> DataFrame:
    """Distinct fingerprints (``node`` and the plan's columns) to edges a, b that connect all linked ones."""
    columns, keys = plan.columns, plan.keys(reps.count())
    keyed_schema = T.StructType([T.StructField("cell", T.LongType()), T.StructField("node", T.LongType()), *[T.StructField(c, T.LongType()) for c in columns]])

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in columns]
            for t, positions in enumerate(keys):
                cell = np.zeros(batch.num_rows, dtype=np.uint64)
                for p in positions:
                    cell = cell << np.uint64(1) | f[p // 64] >> np.uint64(p % 64) & np.uint64(1)
                cell = cell * np.uint64(len(keys)) + np.uint64(t)  # a name that other cells may share by overflow: then they are compared, too
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), batch.column("node"), *[batch.column(c) for c in columns]], names=keyed_schema.names)

    keyed = reps.select("node", *columns).mapInArrow(spread, keyed_schema)
    radius = plan.radius

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def pairs(rows: np.ndarray) -> pa.RecordBatch:
            group = np.concatenate([[0], np.cumsum((rows[1:, :3] != rows[:-1, :3]).any(axis=1))])
            found = np.array(cell_links(group, np.ascontiguousarray(rows[:, 4:]).view(np.uint64), radius), dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(rows[found[:, 0], 3]), pa.array(rows[found[:, 1], 3])], names=EDGE.names)

        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            rows = rows if rest is None else np.concatenate([rest, rows])
            if not len(rows):
                continue
            last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
            whole = last[-1] + 1 if len(last) else 0  # the last cell may go on in the next batch
            rest = rows[whole:]
            if whole:
                yield pairs(rows[:whole])
        if rest is not None and len(rest):
            yield pairs(rest)

    return cut(keyed, ["cell"], F.count(F.lit(1)) / CELL, F.xxhash64("node")).mapInArrow(compare, EDGE).distinct()


def cut(keyed: DataFrame, on: list[str], n_parts: Column, own: Column, keep_own: bool = False) -> DataFrame:
    """Rows with the columns i, j, sorted by ``on``, i, j: of a large cell the parts i and j meet in a task.

    ``n_parts``: an aggregate, how many parts a cell is to have; ``own``: a number that deals its rows to parts,
    whose number stays as a column ``own`` with ``keep_own``.
    """
    rest = [c for c in keyed.columns if c not in on] + (["own"] if keep_own else [])
    large = settle(keyed.groupBy(*on).agg(F.ceil(n_parts).cast("int").alias("parts")).where("parts > 1"), "cells")
    parts = F.coalesce("parts", F.lit(1))
    out = join_small(keyed, large, on, "left").withColumn("own", F.pmod(own, parts)).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    out = out.select(*on, F.least("own", "other").cast("int").alias("i"), F.greatest("own", "other").cast("int").alias("j"), *rest)
    return out.repartition(*on, "i", "j").sortWithinPartitions(*on, "i", "j")


def groups(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row per row of ``docs``: doc_id, the plan's fingerprint columns, component_id.

    Equal fingerprints are one node, named by their smallest doc_id; component_id is the smallest doc_id that links
    reach, the document's own included. Texts without words (null, empty, white space) have fingerprint zero and link
    like others; a long text counts whole. A row whose doc_id is null links nothing; its component_id is that of its
    equals, if it has any. Rows that repeat a doc_id are one document, which links what any of its texts links.
    Further columns, whatever their names, are not read.
    """
    own = settle(fingerprints(docs, plan), "fingerprints")
    reps = settle(own.where("doc_id IS NOT NULL").groupBy(*plan.columns).agg(F.min("doc_id").alias("node")), "distinct")
    # one doc_id may name several texts: then it is one node with several fingerprints, which is what links them
    found = components(links(reps, plan))
    named = reps.join(found, "node", "left").select(*plan.columns, F.coalesce("component", "node").alias("component_id"))
    return own.join(named, plan.columns, "left").select("doc_id", *plan.columns, "component_id")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id."""
    return groups(docs).select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")
