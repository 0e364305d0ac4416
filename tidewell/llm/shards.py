"""Sharding by a keyed permutation of global row numbers.

Rows are numbered by a distributed sort; a Feistel network over the next even power of two, walked until it lands
inside, permutes the numbers. Shard and slot of a row are the permuted number's remainder and quotient by the shard
count, so that anyone who has the row's number and the seed can compute them, and counts differ by one at most.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import number_rows
from .common import seeded

SHARDS, SEED, ROUNDS = 8, 20240131, 6


class Feistel:
    """A permutation of 0 to n - 1 that the seed fixes."""

    def __init__(self, n: int, seed: int = SEED) -> None:
        self.n = n
        self.half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = seeded(f"shards-{seed}", ROUNDS)

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in keys:
            left, right = right, left ^ self._round(right, key)
        return left << self.half | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys[::-1]:
            left, right = right ^ self._round(left, key), left
        return left << self.half | right

    def _walk(self, x, step) -> np.ndarray:
        out = step(np.asarray(x, dtype=np.uint64))
        while len(outside := np.flatnonzero(out >= np.uint64(self.n))):
            out[outside] = step(out[outside])
        return out.astype(np.int64)

    def __call__(self, x) -> np.ndarray:
        return self._walk(x, lambda y: self._once(y, self.keys))

    def inverse(self, x) -> np.ndarray:
        """The row number at a place of the shuffle: a reader finds the source of any slot."""
        return self._walk(x, self._back)


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes of the text and 1), text_crc32, row_number, shard, slot.

    Row numbers follow doc_id, then checksum and size, nulls first; rows equal in all three are interchangeable. A null
    text has no bytes and the checksum of the empty text. An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    numbered = number_rows(own, ["doc_id", "text_crc32", "size"])
    n = numbered.count()
    schema = T.StructType([*numbered.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permute = Feistel(n, seed)
        for batch in batches:
            place = permute(batch.column("row_number").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((place % shards).astype(np.int32)), pa.array(place // shards)], names=schema.names)

    return numbered.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """The law is ``rows``: counts of shards are at most one apart."""
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
