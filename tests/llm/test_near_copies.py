"""Near copies by the Jaccard similarity of five-word shingles, against brute force over all pairs."""

import random

from conftest import SF

from tidewell.llm import near_copies, simhash
from tidewell.llm.common import table


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute(rows):
    """component by doc_id."""
    sets = {}
    for i, t in rows:
        sets.setdefault(frozenset(shingles(t)), []).append(i)
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    distinct = sorted(sets, key=len)
    for n, x in enumerate(distinct):
        for i in sets[x]:
            join(i, sets[x][0])
        for y in distinct[n + 1 :]:
            if len(x) < 0.8 * len(y):
                break
            if jaccard(x, y) >= 0.8:
                join(sets[x][0], sets[y][0])
    return {i: find(i) for i in parent}


def shifted(rng, length, step, n):
    """``n`` windows of a text, each ``step`` words on: neighbours share all but ``step`` shingles at each end."""
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(length + step * n)]
    return [" ".join(words[step * i : step * i + length]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, t int")


def test_texts_under_the_similarity_stay(spark):
    rng = random.Random(1)
    rows, want = [], set()
    for g in range(30):  # chains of 0.7: nothing goes
        texts = shifted(rng, 304, 53, 4)
        assert 0.69 < jaccard(shingles(texts[0]), shingles(texts[1])) < 0.71
        rows += [(g * 10 + i, t) for i, t in enumerate(texts)]
        want |= {g * 10 + i for i in range(4)}
    for g in range(30, 60):  # pairs of 0.98: one goes
        rows += [(g * 10 + i, t) for i, t in enumerate(shifted(rng, 304, 3, 2))]
        want.add(g * 10)
    kept = near_copies.keep_one(frame(spark, rows))
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == ["doc_id", "text", "node", "t"]


def test_groups_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "One two"), (9004, "one TWO"), (9005, "one"), rows[3], (9006, "long " * 30000 + "end"), (9007, "long " * 30000 + "end other")]
    got = {r.doc_id: r.component_id for r in near_copies.groups(frame(spark, rows)).collect()}
    assert got == brute(rows)
    assert near_copies.groups(frame(spark, rows).limit(0)).count() == 0 == near_copies.keep_one(frame(spark, rows).limit(0)).count()


def test_pairs_near_the_similarity(spark):
    """Chains of neighbours between 0.78 and 0.84, in cells cut into many parts and not."""
    rng = random.Random(3)
    rows = [(1000 * g + i, t) for g in range(60) for i, t in enumerate(shifted(rng, 40 + 10 * g, round((36 + 10 * g) * (0.06 + 0.01 * (g % 7))), 4))]
    want = brute(rows)
    assert 60 < len(set(want.values())) < 240
    assert {r.doc_id: r.component_id for r in near_copies.groups(frame(spark, rows)).collect()} == want


def test_large_cells_are_cut(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CELL", 4)
    rng = random.Random(3)
    rows = list(enumerate(shifted(rng, 304, 12, 30) + shifted(rng, 304, 40, 20)))
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in near_copies.groups(frame(spark, rows)).collect()} == want
    assert {r.doc_id for r in near_copies.keep_one(frame(spark, rows)).collect()} == {i for i, c in want.items() if i == c}


def test_pairs_of_the_similarity_meet():
    """At 0.8 and at any number of documents: a shared anchor and fingerprints within the radius."""
    rng, lost = random.Random(5), 0
    for _ in range(2000):
        a, b = (near_copies.shingle_set(t) for t in shifted(rng, 124, 13, 2))
        x, y = (simhash.fingerprint_of(h, near_copies.PRINTS) for h in (a, b))
        apart = sum(int(v).bit_count() for v in x ^ y)
        lost += apart > near_copies.PRINTS.radius or not (near_copies.anchors(a) == near_copies.anchors(b)).any()
    assert lost == 0


def test_repeated_lines_count_once():
    rng, plan = random.Random(6), near_copies.PRINTS
    a = shifted(rng, 104, 1, 1)[0]
    b = a + " " + " ".join([" ".join(a.split()[:8])] * 40)
    assert jaccard(shingles(a), shingles(b)) >= 0.8
    assert sum(int(x).bit_count() for x in simhash.fingerprint(a, plan) ^ simhash.fingerprint(b, plan)) <= plan.radius
