"""Shared pieces: table reading, fixed pseudo-random numbers, batch slicing; durable tables are in ``tables``."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..tables import forget, join_small, scratch, settle

__all__ = ["forget", "join_small", "scratch", "seeded", "settle", "slices", "table"]

#: Words are maximal runs of code points other than space and U+0009 to U+000D.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seeded(name: str, n: int) -> np.ndarray:
    """``n`` unsigned 64-bit numbers that depend on the name only: from SHA-256, so that no library's version matters."""
    return np.frombuffer(b"".join(hashlib.sha256(f"{name}:{i}".encode()).digest()[:8] for i in range(n)), dtype="<u8")


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Half-open ranges of consecutive rows whose sizes add up to ``limit`` at most, or single rows beyond it."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)
