"""Packing: ids equal the tokenizer's, every id lies in one piece, sequences are full."""

import random
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SF
from tokenizers import Tokenizer

from tidewell.llm import packing
from tidewell.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_units_encode_like_whole_texts(tokenizer):
    rng = random.Random(1)
    signs = [" ", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", " ", "　", "᠎", "​", "a", "b", "Z", "é", "ß", "1", "２", "٣", "'s", "'", "'LL", ".", "…", "漢", "क्", "👍🏽", "\U0001f469‍", "<|endoftext|>", "\x00", "ǅ", "Ⅷ", "²", "the", " word"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 40))) for _ in range(3000)] + ["", " ", "a ", " a", "a" * 3000, "é" * 900 + " b", " " * 2000, "a  b", "\n a"]
    for memo in (packing.MEMO, 50):
        coder = packing.UnitEncoder(PATH)
        packing.MEMO, was = memo, packing.MEMO
        try:
            for begin in range(0, len(texts), 500):
                part = texts[begin : begin + 500]
                ids, counts = coder.encode(pa.array(part, pa.string()))
                at = 0
                for t, n in zip(part, counts.tolist(), strict=True):
                    assert ids[at : at + n].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
                    at += n
                assert at == len(ids)
        finally:
            packing.MEMO = was


def check(tokenizer, docs, rows, size):
    """``docs``: (doc_id, text) with different doc_ids."""
    ids = {i: ids_of(tokenizer, t) for i, t in docs}
    by_doc, filled = {}, {}
    for r in rows:
        assert 1 <= r.length <= size and r.doc_tokens == len(ids[r.doc_id])
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == ids.keys()
    for i, runs in by_doc.items():
        assert [s for s, _ in sorted(runs)] == [sum(n for _, n in sorted(runs)[:k]) for k in range(len(runs))] and sum(n for _, n in runs) == len(ids[i])
    total = sum(map(len, ids.values()))
    assert sorted(filled) == list(range(-(-total // size)))
    for s, runs in filled.items():
        assert [o for o, _ in sorted(runs)] == [sum(n for _, n in sorted(runs)[:k]) for k in range(len(runs))]
        assert sum(n for _, n in runs) == (size if s < total // size else total % size)


def test_pieces_of_the_table(spark, tokenizer):
    docs = table(spark, SF, "documents").repartition(7, "doc_id")
    check(tokenizer, [(r.doc_id, r.text) for r in docs.collect()], packing.report(docs, PATH).collect(), 1024)


@pytest.mark.parametrize("size", [8, 1])
def test_odd_documents(spark, tokenizer, size):
    docs = [(1, None), (2, ""), (3, "word " * 500), (4, "  two  spaces \n and <|endoftext|>"), (None, "no id"), (5, "é" * 100), (6, "word " * 500)]
    frame = spark.createDataFrame([(*d, "x", 9) for d in docs], "doc_id long, text string, ids string, n int").repartition(3, "text")
    check(tokenizer, docs, packing.pieces(frame, PATH, size).collect(), size)
    assert packing.pieces(frame.limit(0), PATH).count() == 0


def test_very_long_text(spark, tokenizer):
    docs = [(1, "a long text, again and again. " * 40_000), (2, "x" * 400_000), (3, "end")]
    check(tokenizer, docs, packing.report(spark.createDataFrame(docs, "doc_id long, text string"), PATH).collect(), 1024)


def test_repeated_rows_are_documents(spark):
    frame = spark.createDataFrame([(1, "two words")] * 5, "doc_id long, text string")
    rows = packing.pieces(frame, PATH, 4).collect()
    assert sum(r.length for r in rows) == 15 and {r.sequence_id for r in rows} == {0, 1, 2, 3}


def test_sequences_hold_what_pieces_say(spark, tokenizer):
    docs = table(spark, SF, "documents").select("doc_id", "text").repartition(7, "doc_id")
    for size in (1024, 50):
        ids = {r.doc_id: ids_of(tokenizer, r.text) for r in docs.collect()}
        made = {r.sequence_id: r.ids for r in packing.sequences(docs, PATH, size).collect()}
        pieces = packing.pieces(docs, PATH, size).collect()
        assert len(made) == len({r.sequence_id for r in pieces})
        assert all(made[r.sequence_id][r.offset : r.offset + r.length] == ids[r.doc_id][r.start : r.start + r.length] for r in pieces)
        assert sum(map(len, made.values())) == sum(map(len, ids.values()))
