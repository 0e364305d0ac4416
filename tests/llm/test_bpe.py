import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from tidewell.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load(PATH)


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def samples():
    rng = random.Random(3)
    parts = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "''", "s", "re", "r", "v", " ", "  ", "\n", "\n\n", "\t", " ", "word", "Wörter", "é", "日本", "123", "½", "!", "?!", "‍", "🙂", "́", "l", "\x1c", " ", "<|endoftext|>"]
    return ["", " ", "  ", "\n ", "it's", "'s", " 's", "'re x", "'rx", "''s", "a'll b", "'s's", "'s\n", "'s 's", "'d1", "'t!"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(3000)]


def test_pretokens_follow_the_pattern(vocabulary):
    pattern = regex.compile(P.PATTERN)
    for text in samples():
        if text:
            starts = bpe.pretoken_starts(np.array([ord(c) for c in text], dtype=np.uint32), np.array([0]), vocabulary.kinds).tolist()
            assert [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)] == pattern.findall(text), repr(text)


def test_ids_equal_the_library(vocabulary, reference):
    texts = samples() + ["abc " * 5000, "a" * 3000, "x" * 5 + "\n" * 2000]
    for text, ids in zip(texts, bpe.Encoder(vocabulary).encode(texts), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text), repr(text[:80])
        assert vocabulary.decode(ids) == text.encode()


def test_perfect_hash_is_minimal(vocabulary):
    assert sorted(vocabulary.lookup.slot_of) == list(range(len(vocabulary.ranks)))
    assert all(vocabulary.whole(t) == r for t, r in vocabulary.ranks.items())
    assert vocabulary.whole(b"no such token at all") == -1


def test_frames(spark, reference):
    rows = [(1, "Hello world's", 1), (2, None, 2), (3, "", 3), (1, "Hello world's", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(bpe.report(docs, PATH).collect())
    want = reference.encode_ordinary("Hello world's")
    assert got[0] == got[1] and got[0].n_tokens == len(want)
    assert got[0].ids_sha256 == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
    assert got[0].decoded_sha256 == hashlib.sha256(b"Hello world's").hexdigest()
    assert got[2].n_tokens == 0 and got[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    back = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted(bytes(r.decoded) for r in back) == [b"", b"", b"Hello world's", b"Hello world's"]
    assert bpe.report(docs.limit(0), PATH).count() == 0


def test_pretokens_of_equal_polynomial_hashes(vocabulary, reference):
    """A Thue-Morse word and its complement collide under any polynomial hash modulo 2 ** 64."""
    for n in (1024, 2048, 4096):
        word = "".join("aq"[i.bit_count() & 1] for i in range(n))
        other = word.translate(str.maketrans("aq", "qa"))
        texts = [word, other, word + " " + other]
        got = bpe.Encoder(vocabulary).encode(texts)
        assert [g.tolist() for g in got] == [reference.encode_ordinary(t) for t in texts]
        assert [vocabulary.decode(g).decode() for g in got] == texts
