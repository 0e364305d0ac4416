import random
import re

import numpy as np
import xxhash
from conftest import SF

from tidewell.llm import simhash
from tidewell.llm.common import table


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, radius=3):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(ids[i]), find(ids[j])
                parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in ids}


def test_within_counts_all_distances():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 63, (40, 1), dtype=np.uint64)
    for i in range(1, 40):  # chains of few differences
        if i % 3:
            words[i] = words[i - 1] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 8), replace=False)))
    planes = simhash._planes(words)
    for radius in (0, 1, 2, 3, 5, 7):
        for shift in (1, 2, 5):
            got = simhash.within(planes, shift, (1 << 40 - shift) - 1, radius)
            assert [got >> i & 1 for i in range(40 - shift)] == [int(bin(int(words[i, 0] ^ words[i + shift, 0])).count("1") <= radius) for i in range(40 - shift)]


def test_cells_link_all_sizes():
    rng = random.Random(2)
    for sizes in ([1, 2, 3, 9, 70], [200], [1] * 20, [65, 64, 8, 7]):
        group = np.repeat(np.arange(len(sizes)), sizes)
        base = [rng.getrandbits(64) for _ in range(6)]
        prints = [rng.choice(base) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in group]
        found = simhash.cell_links(group, np.array(prints, dtype=np.uint64).reshape(-1, 1), 3)
        want = {}
        for g in range(len(sizes)):
            rows = np.flatnonzero(group == g).tolist()
            want |= brute_components(rows, [prints[r] for r in rows])
        parent = {r: r for r in range(len(group))}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in found:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        assert {r: find(r) for r in parent} == want
        assert len(found) == len(group) - len(set(want.values()))


def test_report_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000, None), (1001, ""), (1002, " \n"), (1003, "One"), (1004, "one"), (1005, "a b"), (1006, "A B c D e"), (1007, "Very Long " * 40_000 + "end"), (1008, "very long " * 40_000 + "end"), (5, docs.where("doc_id = 5").first().text)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, f0 int")
    got = simhash.report(frame).collect()
    prints = {t: brute_fingerprint(t) for _, t in rows}
    assert sorted((r.doc_id, r.fingerprint) for r in got) == sorted((i, f"{prints[t]:016x}") for i, t in rows)
    want = brute_components([i for i, _ in rows], [prints[t] for _, t in rows])
    assert {r.doc_id: r.component_id for r in got} == want
    assert simhash.report(frame.limit(0)).count() == 0


def test_large_cells_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 16)
    rng = random.Random(4)
    base = rng.getrandbits(62)
    prints = sorted({base ^ sum(1 << b for b in rng.sample(range(62), 4)) for _ in range(150)})
    reps = spark.createDataFrame([(i, f) for i, f in enumerate(prints)], "node long, f0 long")
    edges = simhash.links(reps, simhash.Plan())
    found = {r.node: r.component for r in simhash.components(edges).collect()}
    want = brute_components(list(range(len(prints))), prints)
    assert {i: found.get(i, i) for i in range(len(prints))} == want


def test_keys_lose_no_link():
    rng = random.Random(3)
    plan = simhash.Plan()
    for n, count, size in ((1000, 4, 16), (10**9, 10, 25), (10**11, 20, 31)):
        keys = plan.keys(n)
        assert len(keys) == count and min(map(len, keys)) >= size
        for _ in range(500):
            differ = set(rng.sample(range(64), 3))
            assert any(not differ & set(k) for k in keys)
