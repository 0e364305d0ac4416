"""Removal of passages that a document with a smaller id also holds.

Every window of WINDOW words gets two Rabin-Karp hashes, 128 bits, of which 88 travel. Tasks send those of their documents to buckets,
packed, a window that several documents of a slice share once only (of the smallest id; the others are marked at once).
A bucket finds each window's smallest doc_id and marks it in all later documents. Marks return to their documents,
whose texts move compressed, where marked windows merge into maximal intervals of words, which go.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from .common import slices

WINDOW = 13
#: Bytes of text whose windows a task packs together, and windows that a bucket holds on average.
SLICE_BYTES, BUCKET_WINDOWS = 12 << 20, 1 << 21
#: Bytes of text in a group of documents that gets its marks together, on average.
GROUP_BYTES = 8 << 20
#: Buckets to which a task sends windows at once.
FAN_OUT = 4096
_BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def window_hashes(words: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each run of ``window`` words, of 64, 24 and 40 bits: polynomials, modulo 2^64, in the words' own 128-bit hashes.

    The first two travel; the third only deals windows to buckets, and so tells windows apart as far as there are buckets.
    """
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint64)
    both = np.frombuffer(b"".join(map(xxh3_128_digest, words)), dtype=np.uint64).reshape(-1, 2)
    out = []
    for h, base in zip(both.T, _BASES, strict=True):
        h = np.ascontiguousarray(h)
        x = h[:n].copy()
        for k in range(1, window):
            x *= base
            x += h[k : n + k]
        out.append((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93))
    return out[0], (out[1] >> np.uint64(40)).astype(np.uint32), out[1] & np.uint64((1 << 40) - 1)


def sorted_windows(h: np.ndarray, check: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """The order of windows by both hashes, then by ``own`` or as they stand.

    Windows of one first hash and different second ones are so rare that sorting by the first comes first.
    """
    order = np.argsort(h, kind="stable") if own is None else np.lexsort((own, h))
    x, y = h[order], check[order]
    if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():
        order = np.lexsort((check, h)) if own is None else np.lexsort((own, check, h))
    return order


def heads_of(h: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Where a new window begins among sorted ones."""
    return np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])])[: len(h)]


def marked_in(h: np.ndarray, check: np.ndarray, marks: np.ndarray, mark_checks: np.ndarray) -> np.ndarray:
    """Which windows are among the marked ones; both hashes count."""
    if not len(marks) or not len(h):
        return np.zeros(len(h), dtype=bool)
    order = sorted_windows(marks, mark_checks)
    marks, mark_checks = marks[order], mark_checks[order]
    first, last = np.searchsorted(marks, h, side="left"), np.searchsorted(marks, h, side="right")
    out = np.zeros(len(h), dtype=bool)
    for k in range(int((last - first).max())):  # one, or as many as there are repeated or colliding marks
        at = np.minimum(first + k, len(marks) - 1)
        out |= (first + k < last) & (mark_checks[at] == check)
    return out


def covered(flags: np.ndarray, n_words: int, window: int = WINDOW) -> np.ndarray:
    """Which words lie under a flagged window."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    at = np.flatnonzero(flags)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) > 0


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true values, end exclusive."""
    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def groups_of(ids, groups: int):
    """The group of a doc_id, for numpy arrays and for columns alike."""
    if isinstance(ids, Column):
        return F.pmod(ids.bitwiseXOR(F.shiftright(ids, 16)), F.lit(groups))
    return (ids ^ (ids >> 16)) % groups


def marks(docs: DataFrame, total: int, groups: int, window: int = WINDOW) -> DataFrame:
    """Windows whose words a document of a smaller id also holds, packed by groups of documents.

    ``grp``, and as binary: ``docs`` (64-bit ids) and ``counts`` (32-bit, how many windows each has), compressed,
    ``hashes`` (64-bit), ``checks`` (24-bit). ``total``: bytes of all texts. Beyond FAN_OUT buckets a task's windows
    would come in rows of a few: then they go to a smaller number of wide buckets first and are packed again there.
    """
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = max(1, -(-total // (4 * BUCKET_WINDOWS)))  # a word and its gap have four bytes at least, as a rule
    wide = buckets if buckets <= FAN_OUT else math.isqrt(buckets)
    narrow = -(-buckets // wide)
    names = ["docs", "counts", "hashes", "checks"]
    packed = T.StructType([T.StructField("bucket", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in names]])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for begin, end in slices(sizes, SLICE_BYTES):
                found = [window_hashes(words_of(x.as_py()), window) for x in texts.slice(begin, end - begin)]
                own = np.repeat(ids[begin:end], [len(x[0]) for x in found])
                h, check, place = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(h):
                    continue
                # within a slice only a window's smallest document goes to the bucket
                order = sorted_windows(h, check, own)
                h, check, own, place = h[order], check[order], own[order], place[order]
                new = heads_of(h, check)
                least = own[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
                late = (own > least) & np.concatenate([[True], new[1:] | (own[1:] != own[:-1])])
                yield from rows(-1 - groups_of(own[late], groups), own[late], h[late], check[late])
                yield from rows((place[new] % np.uint64(wide)).astype(np.int64), own[new], h[new], check[new])

    def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by wide bucket to rows by bucket, of as many windows at a time as a bucket has."""
        def emit(bucket: int, held: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
            own, h, check = _unpacked(held)
            yield from rows(bucket * narrow + (h >> np.uint64(16)).astype(np.int64) % narrow, own, h, check)

        last, held, size = None, [], 0
        for batch in batches:
            for bucket, *columns in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (bucket != last or size > 8 * BUCKET_WINDOWS):
                    yield from emit(last, held)
                    held, size = [], 0
                if bucket < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), *[pa.array([x], pa.binary()) for x in columns]], names=packed.names)
                else:
                    last, size = bucket, size + len(columns[2])
                    held.append(columns)
        if held:
            yield from emit(last, held)

    def rows(bucket: np.ndarray, own: np.ndarray, h: np.ndarray, check: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One row per bucket; its hashes stand by document. Bucket -1 - g holds what is marked already for group g."""
        squeeze = zstandard.ZstdCompressor(level=1).compress
        order = np.lexsort((own, bucket))
        bucket, own, h, check = bucket[order], own[order], h[order], check[order]
        at = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(h)]]) if len(h) else np.zeros(1, dtype=np.int64)
        out: list[list] = [[] for _ in packed]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            heads = np.concatenate([[0], np.flatnonzero(own[a + 1 : b] != own[a : b - 1]) + 1])
            ids = np.diff(own[a:b][heads], prepend=np.int64(0))  # sorted, so that differences are small
            row = (int(bucket[a]), squeeze(ids.tobytes()), squeeze(np.diff(np.append(heads, b - a)).astype(np.int32).tobytes()), h[a:b].tobytes(), np.ascontiguousarray(check[a:b].view(np.uint8).reshape(-1, 4)[:, :3]).tobytes())
            for column, value in zip(out, row, strict=True):
                column.append(value)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *[pa.array(x, pa.binary()) for x in out[1:]]], names=packed.names)

    marked = T.StructType([T.StructField("grp", T.LongType()), *packed.fields[1:]])

    def find(part: pd.DataFrame) -> pd.DataFrame:
        bucket = int(part["bucket"].iloc[0])
        if bucket < 0:  # marked by a slice
            return part.rename(columns={"bucket": "grp"}).assign(grp=-1 - bucket)
        own, h, check = _unpacked(list(zip(*[part[c] for c in names], strict=True)))
        order = sorted_windows(h, check)
        h, check, own = h[order], check[order], own[order]
        heads = np.flatnonzero(heads_of(h, check))
        least = np.repeat(np.minimum.reduceat(own, heads), np.diff(np.append(heads, len(h))))
        late = own > least
        out = [b.to_pandas() for b in rows(groups_of(own[late], groups), own[late], h[late], check[late])]
        return out[0].rename(columns={"bucket": "grp"}) if out else pd.DataFrame({f.name: [] for f in marked})

    sent = docs.mapInArrow(pack, packed)
    if wide < buckets:
        sent = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(again, packed)
    return sent.groupBy("bucket").applyInPandas(find, marked)


def _unpacked(packs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and second hash of each window from packs of docs, counts, hashes, checks."""
    grow = zstandard.ZstdDecompressor().decompress
    read = lambda x, kind: np.frombuffer(x, dtype=kind)
    own = [np.repeat(np.cumsum(read(grow(p[0]), np.int64)), read(grow(p[1]), np.int32)) for p in packs]
    checks = read(b"".join(p[3] for p in packs), np.uint8).reshape(-1, 3)
    four = np.zeros((len(checks), 4), dtype=np.uint8)
    four[:, :3] = checks
    return np.concatenate([np.zeros(0, dtype=np.int64), *own]), read(b"".join(p[2] for p in packs), np.uint64), four.view(np.uint32).ravel()


def bundles(docs: DataFrame, groups: int) -> DataFrame:
    """Documents packed by group, so that texts move compressed: ``grp``, and as binary ``docs``, ``known`` (0 for a null doc_id), ``sizes``, ``texts``."""
    schema = T.StructType([T.StructField("grp", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("docs", "known", "sizes", "texts")]])
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = own.withColumn("grp", F.coalesce(groups_of(F.col("doc_id"), groups), F.pmod(F.xxhash64("text"), F.lit(groups))))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            texts = batch.column("text")
            for begin, end in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), SLICE_BYTES):
                ids, grp = batch.column("doc_id").slice(begin, end - begin), batch.column("grp").slice(begin, end - begin).to_numpy()
                known, ids = np.array(ids.is_valid()).astype(np.uint8), pc.fill_null(ids, 0).to_numpy()
                data = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in texts.slice(begin, end - begin)]
                order = np.argsort(grp, kind="stable")
                out: list[list] = [[] for _ in schema]
                for part in np.split(order, np.flatnonzero(np.diff(grp[order])) + 1) if len(order) else []:
                    row = (int(grp[part[0]]), ids[part].tobytes(), known[part].tobytes(), np.array([len(data[i]) for i in part], dtype=np.int64).tobytes(), squeeze(b"".join(data[i] for i in part)))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *[pa.array(x, pa.binary()) for x in out[1:]]], names=schema.names)

    return own.mapInArrow(pack, schema)


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and the removed intervals of words.

    A null text has no words. Rows that repeat a doc_id are one document to the others and are judged alike; a row
    without doc_id neither loses words nor costs others any. Further columns, whatever their names, are not read.
    Hashes of 88 bits, and the bucket, which further ones give, stand for a window. Among N different windows in B
    buckets, or wide ones, some two are taken for equal with probability N * N / (B * 2^89), 1 in 4,000 at 100 TB.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES)) | 1
    found = marks(docs, total, groups, window)
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("removed", span)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        names, h, check = _unpacked(list(zip(*[right.column(c).to_pylist() for c in ("docs", "counts", "hashes", "checks")], strict=True)))
        order = np.argsort(names, kind="stable")
        names, h, check = names[order], h[order], check[order]
        out: list[list] = [[] for _ in schema]
        for bundle in left.select(["docs", "known", "sizes", "texts"]).to_batches():
            for ids, known, sizes, texts in zip(*bundle.columns, strict=True):
                data, at = zstandard.decompress(texts.as_py()), 0
                for doc, own, size in zip(np.frombuffer(ids.as_py(), dtype=np.int64).tolist(), known.as_py(), np.frombuffer(sizes.as_py(), dtype=np.int64).tolist(), strict=True):
                    words, at = data[at : at + size].split(), at + size
                    gone = np.zeros(len(words), dtype=bool)
                    a, b = np.searchsorted(names, [doc, doc + 1]) if own else (0, 0)
                    if b > a:
                        gone = covered(marked_in(*window_hashes(words, window)[:2], h[a:b], check[a:b]), len(words), window)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
                    row = (doc if own else None, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"start": x, "end": y} for x, y in intervals(gone)])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
        return pa.table({"doc_id": pa.array(out[0], pa.int64()), "n_words": pa.array(out[1], pa.int64()), "n_removed": pa.array(out[2], pa.int64()), "kept_sha256": pa.array(out[3], pa.string()), "removed": pa.array(out[4], kind)})

    return bundles(docs, groups).groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(cut, schema)


SQL = rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
windows AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - {WINDOW - 2}), lambda i: {{'i': i, 's': array_to_string(ws[i:i + {WINDOW - 1}], ' ')}})) AS x FROM w WHERE len(ws) >= {WINDOW}),
m AS (SELECT doc_id, x.i AS i, min(doc_id) OVER (PARTITION BY x.s) AS least FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM m WHERE least < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.k) AS t, count(*) AS n FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.k = words.k WHERE gone.k IS NULL GROUP BY words.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
