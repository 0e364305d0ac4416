"""Packing of tokenised documents into sequences of one size, by concatenation and cuts.

First pass: every task tokenises its documents and adds up their tokens; the table it leaves holds each document's ids,
the number of its partition and the tokens before it there. The partitions' totals, one row each, give by a prefix sum
where each partition begins in the concatenation of all. Second pass: a document's place is that plus what lies before
it, so tasks cut it at multiples of the size without knowing any other document. Only sequences that a task doesn't hold
whole, at most two for each run of rows that it reads, leave boundary records, which meet by the sequence's number.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, slices

#: Bytes of text that are split at once, characters that a remembered unit has at most, units remembered at most.
SLICE_BYTES, UNIT, MEMO = 8 << 20, 48, 800_000
#: Units that are encoded in one string.
JOINED = 200
#: Where a space follows white space, in the sense of Python and of the tokenizer.
_SPACES = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}] "
#: Words between single line breaks, without other white space.
_LINES = r"^[^\s\x0B\x1C-\x1F\x{85}\p{Z}]+(\n[^\s\x0B\x1C-\x1F\x{85}\p{Z}]+)+$"
#: A word and signs after it, none an apostrophe: a pre-token ends between them.
_TAIL = r"^(?s:(?P<core>.*\p{L})(?P<tail>[!-&(-/:-@\[-`{-~]+))$"
_AFTER_WORD = regex.compile(r"(?<=[^\s\x1c-\x1f\x85]) ")


def _spread(starts: np.ndarray, counts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The places of what each of ``which`` has, one after the other; item i has ``counts[i]`` from ``starts[i]`` on."""
    each = counts[which]
    ends = np.cumsum(each)
    return np.repeat(starts[which] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)


class Known:
    """Atoms and their ids, many at a time. Beyond ``MEMO`` those that were not met again make room, long ones always do."""

    def __init__(self, kind: np.dtype) -> None:
        self.atoms, self.flat = pa.array([], pa.string()), np.zeros(0, dtype=kind)
        self.counts, self.hits = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def trim(self) -> None:
        keep = pc.less_equal(pc.binary_length(self.atoms), UNIT).to_numpy(zero_copy_only=False)
        if keep.sum() > MEMO:
            met = keep & (self.hits > 0)
            keep = met if met.sum() <= MEMO // 2 else np.zeros_like(keep)
            self.hits[:] = 0
        if not keep.all():
            self.flat = self.flat[np.repeat(keep, self.counts)]
            self.atoms, self.counts, self.hits = self.atoms.filter(pa.array(keep)), self.counts[keep], self.hits[keep]

    def places(self, atoms: pa.Array, encode: Callable[[list[str]], list[bytes]]) -> np.ndarray:
        """Where each atom's ids are; new ones are encoded and added."""
        at = pc.fill_null(pc.index_in(atoms, value_set=self.atoms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.hits += np.bincount(at[at >= 0], minlength=len(self.hits))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = atoms.take(pa.array(new)).dictionary_encode()
            ids = encode(fresh.dictionary.to_pylist())
            at[new] = len(self.atoms) + fresh.indices.to_numpy(zero_copy_only=False)
            self.atoms = pa.concat_arrays([self.atoms, fresh.dictionary])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), dtype=self.flat.dtype)])
            self.counts = np.concatenate([self.counts, np.fromiter(map(len, ids), np.int64, len(ids)) // self.flat.itemsize])
            self.hits = np.concatenate([self.hits, np.zeros(len(ids), dtype=np.int64)])
        return at


class UnitEncoder:
    """Ids of whole texts by a byte-level tokenizer whose pre-tokens never hold a space but as their first character.

    A text is cut into units before each space that follows a character other than white space: there a pre-token ends
    in any case, so units encode separately. A unit is cut into atoms where a pre-token must end: around a line break
    between other characters, and between a letter and the signs after it. Atoms, words for the most part, go to the
    tokenizer once, many in one string, and are remembered; all else is done on whole columns. Strings of special tokens
    are ordinary text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        alphabet = [*range(33, 127), *range(161, 173), *range(174, 256)]
        plain = {chr(c) for c in alphabet} | {chr(256 + i) for i in range(256 - len(alphabet))}  # byte-level signs
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token) if set(token) <= plain else len(token.encode())
        # atoms that follow a space, which they come without, and those that follow none
        self.spaced, self.bare = Known(self.kind), Known(self.kind)

    def _joined(self, parts: list[str]) -> list[bytes]:
        """Ids of the parts of a text between whose tokens each part ends."""
        ids = np.array(self.tokenizer.encode("".join(parts), add_special_tokens=False).ids, dtype=self.kind)
        ends = np.cumsum([len(p.encode()) for p in parts])
        cuts = ((np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1) * self.kind.itemsize).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _encode(self, atoms: list[str], bare: bool) -> list[bytes]:
        """In one string a space or a line break begins each; those that begin or end in white space are encoded apart."""
        lead = "" if bare else " "
        out: list[bytes] = [b""] * len(atoms)
        apart = [i for i, u in enumerate(atoms) if len(u) > UNIT or not u or u[0].isspace() or u[-1].isspace()]
        for i, e in zip(apart, self.tokenizer.encode_batch([lead + atoms[i] for i in apart], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype=self.kind).tobytes()
        there = set(apart)
        rest = [i for i in range(len(atoms)) if i not in there]
        for begin in range(0, len(rest), JOINED):
            part = rest[begin : begin + JOINED]
            found = self._joined([x for i in part for x in ("\n", atoms[i])])[1::2] if bare else self._joined([f" {atoms[i]}" for i in part])
            for i, ids in zip(part, found, strict=True):
                out[i] = ids
        return out

    def _units(self, units: pa.Array, bare: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, and how many each has. Each part of a unit between line breaks is a break, a core and a tail, of which the core is always there."""
        broken = pc.match_substring_regex(units, _LINES).to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(~broken), np.flatnonzero(broken)])
        lines = pc.split_pattern(units.filter(pa.array(broken)), "\n")
        parts = pa.concat_arrays([units.filter(pa.array(~broken)), lines.flatten()])
        sizes = np.concatenate([np.ones(int((~broken).sum()), dtype=np.int64), np.diff(lines.offsets.to_numpy(zero_copy_only=False).astype(np.int64))])
        firsts = np.zeros(len(parts), dtype=bool)
        firsts[np.cumsum(sizes) - sizes] = True
        cut = pc.extract_regex(parts, _TAIL)
        tailed = cut.is_valid().to_numpy(zero_copy_only=False)
        cores = pc.if_else(pa.array(tailed), pc.struct_field(cut, "core"), parts)
        spaced = firsts & (not bare)
        slots = np.full((len(parts), 3), -1, dtype=np.int64)
        slots[spaced, 1] = self.spaced.places(cores.filter(pa.array(spaced)), lambda x: self._encode(x, False))
        tails = pc.struct_field(cut, "tail").filter(pa.array(tailed))
        others = pa.concat_arrays([cores.filter(pa.array(~spaced)), tails, pa.array(["\n"], pa.string())])
        at = self.bare.places(others, lambda x: self._encode(x, True)) + len(self.spaced.atoms)
        n = int((~spaced).sum())
        slots[~spaced, 1], slots[tailed, 2], slots[~firsts, 0] = at[:n], at[n:-1], at[-1]
        there = slots >= 0
        each = np.add.reduceat(there.sum(axis=1), np.cumsum(sizes) - sizes) if len(parts) else np.zeros(0, dtype=np.int64)
        used = slots[there]
        counts = np.concatenate([self.spaced.counts, self.bare.counts])
        ids = np.concatenate([self.spaced.flat, self.bare.flat])[_spread(np.cumsum(counts) - counts, counts, used)]
        total = np.add.reduceat(counts[used], np.cumsum(each) - each) if len(used) else np.zeros(0, dtype=np.int64)
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return ids[_spread(np.cumsum(total) - total, total, back)], total[back]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, none null, and how many each has."""
        self.spaced.trim()
        self.bare.trim()
        odd = pc.match_substring_regex(texts, _SPACES)
        parts = pc.split_pattern(texts, " ")
        if pc.any(odd).as_py():
            parts = pa.array([_AFTER_WORD.split(t) if o else p for t, o, p in zip(texts.to_pylist(), odd.to_pylist(), parts.to_pylist(), strict=True)], pa.list_(pa.string()))
        begins = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        begins, units = begins - begins[0], parts.flatten()
        coded = units.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        heads = begins[:-1]  # the first unit of a text follows no space
        flat, counts = self._units(coded.dictionary, False)
        first, more = self._units(units.take(pa.array(heads)), True)
        which[heads] = len(counts) + np.arange(len(heads))
        flat, counts = np.concatenate([flat, first]), np.concatenate([counts, more])
        bounds = np.concatenate([[0], np.cumsum(counts[which])])[begins]
        return flat[_spread(np.cumsum(counts) - counts, counts, which)], np.diff(bounds)


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The encoder of a file, once in a worker process, so that what it remembers serves later tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def tokenised(docs: DataFrame, path: str, end: int = 0) -> DataFrame:
    """The first pass, in the shared folder: doc_id, ids (binary), n, part, before.

    ``docs`` has doc_id and text. Each document's ids are those of its whole text, none for a null one, then ``end``;
    they are little-endian unsigned numbers of two bytes where the vocabulary has at most 65,536 ids, else of four.
    """
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, before = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            for begin, stop in slices(sizes, SLICE_BYTES):
                ids, counts = coder.encode(pc.fill_null(batch.column("text").slice(begin, stop - begin), ""))
                ids = np.insert(ids, np.cumsum(counts), end).astype(coder.kind)
                counts = counts + 1
                ends = np.cumsum(counts)
                offsets = np.concatenate([[0], ends]) * ids.itemsize
                packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, stop - begin), packed, pa.array(counts, pa.int64()), pa.array(np.full(len(counts), part, dtype=np.int32)), pa.array(before + ends - counts, pa.int64())], names=schema.names)
                before += int(ends[-1])

    return settle(docs.mapInArrow(run, schema), "tokens")


def placed(tokens: DataFrame) -> DataFrame:
    """Add ``place``, where a document begins in the concatenation of all partitions in the order of their numbers."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("_n"))  # one row for each partition of the first pass
    before = F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("part", before.alias("_base"))
    return tokens.join(F.broadcast(bases), "part").withColumn("place", F.col("_base") + F.col("before")).select("doc_id", "ids", "n", "place")


def _cuts(place: int, n: int, size: int) -> list[tuple[int, int]]:
    """Begin and length, in the document, of its pieces: it is cut where a multiple of the size lies."""
    inner = range((place // size + 1) * size, place + n, size)
    at = [0, *[x - place for x in inner], n]
    return list(zip(at[:-1], [b - a for a, b in zip(at[:-1], at[1:], strict=True)], strict=True))


def pieces(docs: DataFrame, path: str, size: int = 1024, end: int = 0) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece of a document.

    The documents' ids stand one after the other, in the order of the input's partitions and of the rows in them, and
    sequence i is what lies from i * ``size`` on; only the last sequence can be shorter. So padding is less than one
    sequence in all. A null or empty text has one id, ``end``; a very long one has many pieces; equal rows, and rows
    without doc_id, are documents of their own; an empty table gives no row. Further columns are not read.
    """
    tokens = placed(tokenised(docs, path, end))
    schema = T.StructType([tokens.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, ...]] = []
            which: list[int] = []
            for i, (raw, n, place) in enumerate(zip(batch.column("ids"), batch.column("n").to_pylist(), batch.column("place").to_pylist(), strict=True)):
                ids = np.frombuffer(raw.as_buffer(), dtype="<u2" if raw.as_buffer().size == 2 * n else "<u4")
                for start, length in _cuts(place, n, size):
                    rows.append((start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes()), n, (place + start) // size, (place + start) % size))
                    which.append(i)
            columns = np.array(rows, dtype=np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(which, pa.int64())), *[pa.array(columns[:, c]) for c in range(6)]], names=schema.names)

    return tokens.mapInArrow(run, schema)


def sequences(docs: DataFrame, path: str, size: int = 1024, end: int = 0) -> DataFrame:
    """sequence_id and ids (array of ints) of every sequence, ``size`` long but for the last one.

    A task emits the sequences that it holds whole; of the others, at the ends of what it reads, it emits boundary
    records, and only these are shuffled.
    """
    tokens = placed(tokenised(docs, path, end))
    schema = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # neighbours in one sequence, at most ``size`` ids of at most ``size`` documents
        begin = until = -1
        out: list[tuple[int, np.ndarray]] = []

        def batch_of() -> pa.RecordBatch:
            places = np.array([p for p, _ in out], dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(x) for _, x in out])]).astype(np.int32)
            values = np.concatenate([x for _, x in out]).astype(np.int32) if out else np.zeros(0, dtype=np.int32)
            return pa.RecordBatch.from_arrays([pa.array(places // size), pa.array(places % size), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=schema.names)

        for batch in batches:
            for raw, n, place in zip(batch.column("ids"), batch.column("n").to_pylist(), batch.column("place").to_pylist(), strict=True):
                ids = np.frombuffer(raw.as_buffer(), dtype="<u2" if raw.as_buffer().size == 2 * n else "<u4")
                for start, length in _cuts(place, n, size):
                    at = place + start
                    if held and (at != until or at % size == 0):
                        out.append((begin, np.concatenate(held)))
                        held = []
                    if not held:
                        begin = at
                    held.append(ids[start : start + length].astype(np.uint32))
                    until = at + length
                    if len(out) >= 1000:
                        yield batch_of()
                        out = []
        if held:
            out.append((begin, np.concatenate(held)))
        yield batch_of()

    cut = settle(tokens.mapInArrow(run, schema), "sequences")
    whole = cut.where(F.size("ids") == size).select("sequence_id", "ids")
    ends = cut.where(F.size("ids") < size).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("runs"))  # at most ``size`` records each
    return whole.unionByName(ends.select("sequence_id", F.flatten("runs.ids").alias("ids")))


def report(docs: DataFrame, path: str) -> DataFrame:
    return pieces(docs, path)
