"""Byte-level BPE encoding and decoding with published ranks.

A text is cut into pre-tokens by the pattern of the ranks, found here by runs of character classes over whole slices
of documents. Tier one looks a whole pre-token up in a minimal perfect hash of the vocabulary; what misses goes to
tier two, merges by rank with a heap over a linked list of bytes. Each distinct pre-token of a slice is encoded once
and a bounded memo carries results to the next slices of the same task.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Bytes of text encoded together, and results that the memo holds before it starts again.
SLICE_BYTES, MEMO = 3 << 17, 250_000
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Suffixes that an apostrophe takes as a token of its own, by the pattern of the ranks (fixed values).
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys to slots 0 to n - 1; a key outside finds a slot whose key differs."""

    def __init__(self, keys: list[bytes]) -> None:
        self.n, self.buckets = len(keys), max(1, len(keys) // 4)
        groups: dict[int, list[int]] = {}
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            groups.setdefault(h % self.buckets, []).append(i)
        self.displace, self.slot_of = [0] * self.buckets, [0] * self.n
        taken = bytearray(self.n)
        for bucket, members in sorted(groups.items(), key=lambda x: -len(x[1])):
            d = 0
            while True:
                slots = [self._slot(hashes[i], d) for i in members]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.displace[bucket] = d
            for i, s in zip(members, slots, strict=True):
                taken[s] = 1
                self.slot_of[i] = s

    def _slot(self, h: int, d: int) -> int:
        return (((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 20) % self.n

    def __call__(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        return self._slot(h, self.displace[h % self.buckets])


@dataclass
class Vocabulary:
    """``tokens[id]`` are a token's bytes."""

    ranks: dict[bytes, int]
    tokens: list[bytes] = field(init=False)
    lookup: PerfectHash = field(init=False)

    def __post_init__(self) -> None:
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        keys = list(self.ranks)
        self.lookup = PerfectHash(keys)
        self.keys, self.ids = [b""] * len(keys), [0] * len(keys)
        for key, slot in zip(keys, self.lookup.slot_of, strict=True):
            self.keys[slot], self.ids[slot] = key, self.ranks[key]
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.ends = np.cumsum(self.lengths)
        self.flat = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.kinds = _kinds()
        self.pairs = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]

    def whole(self, piece: bytes) -> int:
        """The id of a piece that is in the vocabulary, or -1."""
        slot = self.lookup(piece)
        return self.ids[slot] if self.keys[slot] == piece else -1

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        found = self.whole(piece)
        return (found,) if found >= 0 else self._merge(piece)

    def _merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the adjacent pair of lowest rank, the leftmost of equals, until none is in the vocabulary."""
        rank_of, n, pairs = self.ranks.get, len(piece), self.pairs
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that begins at i; an end of 0: none does
        high, low = (16, 8) if n < 256 else (64, 32)  # a heap item is rank, start and stop in one integer
        mask = (1 << low) - 1
        heap = [r << high | i << low | i + 2 for i in range(n - 1) if (r := pairs[piece[i] << 8 | piece[i + 1]]) >= 0]
        heapify(heap)
        while heap:
            x = heappop(heap)
            i, stop = x >> low & mask, x & mask
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two has been merged meanwhile
            end[middle], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (r := rank_of(piece[i : end[stop]])) is not None:
                    heappush(heap, r << high | i << low | end[stop])
            if i and (r := rank_of(piece[(k := before[i]) : stop])) is not None:
                heappush(heap, r << high | k << low | stop)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The joined bytes of the ids' tokens."""
        return self.flat[_ranges(self.ends[ids] - self.lengths[ids], self.lengths[ids])].tobytes()


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start to start + length - 1 of each pair, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """For each code point: letter, number, white space (the Unicode property) or other."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        if category[0] == "L":
            kinds[c] = LETTER
        elif category[0] == "N":
            kinds[c] = NUMBER
        elif category[0] == "Z" or 9 <= c <= 13 or c == 0x85:
            kinds[c] = SPACE
    return kinds


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)})


def pretoken_starts(points: np.ndarray, doc_starts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in joined documents, as code point offsets in order.

    A run of letters, numbers or others takes one space before it. Of white space before such a run all but the last
    code point is one token, and the last, if it isn't a space, another; white space that ends a document is one token.
    A lone apostrophe that doesn't follow a space takes a listed suffix from the letters after it.
    """
    n = len(points)
    kind = kinds[points]
    first = np.zeros(n, dtype=bool)
    first[doc_starts] = True
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run & (kind != SPACE)
    space = kind == SPACE
    start |= space & run
    last = np.empty(n, dtype=bool)  # a document's last code point
    last[:-1] = first[1:]
    last[-1] = True
    tail = space & ~last  # the last white space before a run
    tail[:-1] &= ~space[1:]
    start |= tail
    joins = np.flatnonzero(tail & (points == 0x20)) + 1
    start[joins] = False
    quotes = np.flatnonzero((points == 0x27) & start & ~last)  # begins a token, so no space is joined to it
    quotes = quotes[kind[quotes + 1] == LETTER]
    if len(quotes):
        padded = np.append(points, [0, 0])
        # a suffix must lie in the same document
        inside = np.append(~first, [False, False])
        a, b, two = padded[quotes + 1], padded[quotes + 2], inside[quotes + 2]
        taken = np.zeros(len(quotes), dtype=np.int64)
        for suffix in SUFFIXES:
            hit = (a == ord(suffix[0])) if len(suffix) == 1 else (a == ord(suffix[0])) & two & (b == ord(suffix[1]))
            taken[hit & (taken == 0)] = len(suffix)
        at, size = quotes[taken > 0], taken[taken > 0]
        start[at + 1] = False
        rest = at + 1 + size
        rest = rest[rest < n]
        start[rest] = True
        # the letters' end: a space-joined run after the suffix keeps its own start, set above
        joined = rest[(kind[rest] != SPACE) & (kind[rest] != LETTER)]
        start[joined] = True
    return np.flatnonzero(start)


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.memo, self.older = vocabulary, {}, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit integers."""
        out: list[np.ndarray] = []
        for begin, end in slices([len(t) for t in texts], SLICE_BYTES):
            out += self._slice(texts[begin:end])
        return out

    def _slice(self, texts: list[str]) -> list[np.ndarray]:
        full = [t for t in texts if t]
        if not full:
            return [np.zeros(0, dtype=np.uint32) for _ in texts]
        joined = "".join(full)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(t) for t in full])
        doc_starts = np.cumsum(sizes) - sizes
        begins = pretoken_starts(points, doc_starts, self.v.kinds)
        data = joined.encode("utf-8", "surrogatepass")
        wide = np.ones(len(points), dtype=np.int64)
        if len(data) != len(points):
            wide += (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        place = np.cumsum(wide) - wide
        starts = place[begins]
        ends = np.append(starts[1:], len(data))
        # equal pre-tokens, by their bytes: a dictionary numbers them in order of appearance
        number: dict[bytes, int] = {}
        pieces = [data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        which = np.array([number.setdefault(p, len(number)) for p in pieces], dtype=np.int64)
        if len(self.memo) > MEMO:
            self.memo, self.older = {}, self.memo
        memo, older, encode = self.memo, self.older, self.v.encode_piece
        found = []
        for piece in number:
            ids = memo.get(piece)
            if ids is None:
                ids = memo[piece] = older.get(piece) or encode(piece)
            found.append(ids)
        counts = np.array([len(x) for x in found])
        flat = np.array([i for x in found for i in x], dtype=np.uint32)
        each = counts[which]
        ids = flat[_ranges((np.cumsum(counts) - counts)[which], each)]
        bounds = np.concatenate([[0], np.cumsum(each)])[np.append(np.searchsorted(begins, doc_starts), len(begins))]
        docs = iter([ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        return [next(docs) if t else np.zeros(0, dtype=np.uint32) for t in texts]


def _spread(vocabulary_path: str, df: DataFrame):
    """The vocabulary is a file of fixed size; the driver reads it once."""
    return df.sparkSession.sparkContext.broadcast(load(vocabulary_path))


def encode(docs: DataFrame, vocabulary_path: str, out: str = "ids") -> DataFrame:
    """Add the ids of each whole text as an array of ints; a null or empty text has none. A column named ``out`` is replaced."""
    docs = docs.drop(out)
    shipped, schema = _spread(vocabulary_path, docs), T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shipped.value)
        for batch in batches:
            ids = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(ids)], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    values = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def decode(df: DataFrame, vocabulary_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the decoded bytes of an array of ids; a null array decodes to nothing. A column named ``out`` is replaced."""
    df = df.drop(out)
    shipped, schema = _spread(vocabulary_path, df), T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shipped.value
        for batch in batches:
            lists = batch.column(ids)
            raw = [v.decode(x.values.to_numpy(zero_copy_only=False).astype(np.int64)) if x.is_valid and len(x) else b"" for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def report(docs: DataFrame, vocabulary_path: str, keep_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: token count and digests of the ids and of what they decode to, in one pass over the texts.

    A null or empty text has no tokens, and the digests of no bytes; a text of any length is encoded whole; repeated
    rows give equal rows. Further columns, whatever their names, are not read.
    """
    docs = docs.select("doc_id", "text")
    shipped = _spread(vocabulary_path, docs)
    extra = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), *extra])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shipped.value)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            for begin, end in slices(sizes, SLICE_BYTES):  # texts become Python's a slice at a time
                ids = encoder.encode([t or "" for t in batch.column("text").slice(begin, end - begin).to_pylist()])
                columns = [batch.column("doc_id").slice(begin, end - begin), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(encoder.v.decode(x)).hexdigest() for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(columns + ([_lists(ids)] if keep_ids else []), names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def token_total(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    return report(docs, vocabulary_path).agg(F.sum("n_tokens").alias("n_tokens"))
