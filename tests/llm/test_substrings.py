import hashlib
import random
import re

import numpy as np
import pytest
from conftest import SF

from tidewell.llm import substrings
from tidewell.llm.common import table


def brute(rows, window=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            least[key] = min(i, least.get(key, i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {p for k in range(len(w) - window + 1 if i is not None else 0) if least[tuple(w[k : k + window])] < i for p in range(k, k + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("fan_out", [4096, 9])
def test_documents_equal_brute_force(spark, monkeypatch, fan_out):
    monkeypatch.setattr(substrings, "FAN_OUT", fan_out)
    monkeypatch.setattr(substrings, "SLICE_BYTES", 30_000)
    monkeypatch.setattr(substrings, "BUCKET_WINDOWS", 5_000)
    monkeypatch.setattr(substrings, "GROUP_BYTES", 50_000)
    rng = random.Random(1)
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    passage = " ".join(f"w{i}" for i in range(60))
    rows += [(1000 + i, "x%d " % i + passage[rng.randrange(40) :] + "\n" + passage) for i in range(50)]
    rows += [(5, passage), (5, passage), (2000, None), (2001, ""), (2002, "a b"), (None, passage), (2003, "q " * 40), (2004, "q " * 13)]
    long = " ".join(f"l{i % 5000}" for i in range(30000))
    rows += [(3000, long), (3001, "y " + long + " z"), (3002, "no  \x0b break\u00a0 here \r" * 20)]
    frame = spark.createDataFrame([(i, t, 1, "x", b"y") for i, t in rows], "doc_id long, text string, grp int, docs string, hashes binary")
    got = substrings.report(frame.repartition(5)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(rows)
    assert all(sum(x.end - x.start for x in r.removed) == r.n_removed for r in got)


def test_empty(spark):
    assert substrings.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_both_hashes_count():
    """Windows of one first hash and different second ones are different windows, in any order."""
    rng = np.random.default_rng(2)
    h, check = rng.integers(0, 6, 400).astype(np.uint64), rng.integers(0, 3, 400).astype(np.uint32)
    own = rng.integers(0, 9, 400)
    for order in (substrings.sorted_windows(h, check), substrings.sorted_windows(h, check, own)):
        rows = list(zip(h[order].tolist(), check[order].tolist(), strict=True))
        assert rows == sorted(rows)
        assert substrings.heads_of(h[order], check[order]).sum() == len(set(rows))
    got = substrings.marked_in(h[:200], check[:200], h[200:230], check[200:230])
    marks = set(zip(h[200:230].tolist(), check[200:230].tolist(), strict=True))
    assert got.tolist() == [pair in marks for pair in zip(h[:200].tolist(), check[:200].tolist(), strict=True)] and 0 < got.sum() < 200
    a, b = (substrings.window_hashes([w.encode() for w in t.split()], 3)[:2] for t in ("a b c d a b c", "b c a b c"))
    assert a[0][0] == a[0][4] == b[0][2] and a[1][0] == a[1][4] == b[1][2] and len(set(a[0].tolist())) == 4
