"""Repair of conversations against a brute-force form in plain Python."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from conftest import SF

from tidewell.llm import turns
from tidewell.llm.common import table

GAP = "[^\\x20\\x09-\\x0D]"


def cheapest(rows):
    """Least (cost, audit) and the repaired rows, from the end, all ways tried; rows: (role, text, must go, truncated)."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}  # by the last role

    @lru_cache(maxsize=None)
    def best(i, last, run):
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        new = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
        if run < 3:
            c, a, out = best(i, new[0], run + 1)
            found.append((c + 3, "I" + a, ((new, ""), *out)))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            c, a, out = best(i + 1, last, 0)
            found.append((c + 4, "D" + a, out))
            if not gone:
                if role[:1] and role[:1] in follow[last]:
                    c, a, out = best(i + 1, role[0], 0)
                    found.append((c + 3 * cut, "K" + a, ((role, text), *out)))
                c, a, out = best(i + 1, new[0], 0)
                found.append((c + 3 + 3 * cut, "R" + a, ((new, text), *out)))
        return min(found) if found else (10**9, "", ())

    for i in range(len(rows), 0, -1):  # so that no call goes deep
        for last in ("", "s", "u", "a"):
            best(i, last, 0)
    return best(0, "", 0)


def brute(rows):
    groups = {}
    for conv, turn, role, text in rows:
        group = groups.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        group += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        seen, marked, counts = set(), [], {"b": 0, "d": 0, "t": 0}
        for _, role, text in group:
            chars = re.findall(GAP, text)
            fault = "b" if not chars else "d" if (role, text) in seen else "t" if chars[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role, text, fault in ("b", "d") and fault != "", fault == "t"))
        initials = [r[:1] for _, r, _ in group]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, fixed = cheapest(tuple(marked)) if group else (0, "", ())
        numbers = [t for t, _, _ in group if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[conv] = (gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, digest)
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_equals_brute_force_on_the_table(spark):
    rows = table(spark, SF, "conversations")
    assert got(turns.report(rows)) == brute([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("block", [256, 3])
def test_equals_brute_force_on_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(turns, "BLOCK", block)
    rng = random.Random(3)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "uncle", "été"])
            text = rng.choice(["Yes.", "No", "Why?", " ", "", None, "é!\n\x0b", " ", "word .  ", f"text {rng.random()}."])
            rows.append((conv, rng.choice([turn, turn, turn, None, 2, -4]), role, text))
    rows += rows[:20]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cost int").repartition(5)
    want = brute(rows)
    found = got(turns.report(frame))
    assert {k: (v, want[k]) for k, v in found.items() if v != want[k]} == {} and found.keys() == want.keys()
    assert turns.report(frame.limit(0)).count() == 0


def test_repairs_are_cheapest_and_least():
    rng = random.Random(5)
    signs = [chr(65 + i) for i in range(16)]
    for _ in range(400):
        s = "".join(rng.choice(signs) for _ in range(rng.randrange(0, 9)))
        rows = tuple(({"s": "system", "u": "user", "a": "assistant", ".": "tool"}[a], "x", f in "bd", f == "t") for a, f in map(turns.read, s))
        cost, audit, fixed = cheapest(rows)
        assert turns.repair(s) == (cost, audit)
        made = []
        for (before, letter, role, after), (own, *_) in zip(turns.edits(s, audit), rows):
            made += before + ("" if letter == "D" else (role or own)[0]) + after
        if rows:
            assert made == [r[0] for r, _ in fixed]


def test_stride_does_not_matter(monkeypatch):
    rng = random.Random(8)
    s = "".join(chr(65 + rng.randrange(16)) for _ in range(5000))
    one = turns.repair(s)
    monkeypatch.setattr(turns, "STRIDE", 7)
    assert turns.repair(s) == one


def test_long_conversation_of_copies(spark):
    """A conversation with thousands of messages, most of them equal, and very long texts."""
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"text {i}." if i % 5 == 0 else "same.") for i in range(600)] + [(8, 0, "user", "x" * 300_000 + "."), (8, 1, "assistant", " " * 300_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert got(turns.report(frame)) == brute(rows)


def test_messages_of_the_repaired_table(spark):
    rows = table(spark, SF, "conversations")
    want = {k: v[-1] for k, v in got(turns.report(rows)).items()}
    lines = {}
    for r in sorted(turns.repaired(rows).collect(), key=lambda r: (r.conv_id, r.position)):
        assert len(lines.setdefault(r.conv_id, [])) == r.position
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    empty = hashlib.sha256().hexdigest()
    assert {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in lines.items()} == {k: v for k, v in want.items() if v != empty}
