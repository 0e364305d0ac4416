"""One deterministic automaton for many search rules.

Each rule's regex becomes a Thompson NFA over bytes. Subset construction with ordered threads (the leftmost thread
first) turns it into a search automaton that restarts by itself when a match has ended, so that its accepting states
mark the tails of the leftmost non-overlapping matches. The product of all rules is explored from the start state and
minimised by partition refinement; the result is one transition array over byte classes.

Supported syntax: literals, escapes (``\\xHH``, ``\\.``), ``[...]`` classes, groups, ``|``, ``?``, ``*``, ``+``,
``{m}`` and ``{m,}``. A rule must keep accepting, once it accepts, until it dies (``X C+`` or a fixed end);
``compile_rules`` raises ``ValueError`` otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Rule:
    """``min_tail``: accepting bytes that a match must have at least, others are dropped after the search."""

    kind: str
    pattern: str
    ignore_case: bool = False
    min_tail: int = 1


def _parse(pattern: str, fold: bool):
    """A syntax tree of ("set", frozenset of bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most or None)."""
    at = 0

    def folded(values: set[int]) -> frozenset[int]:
        if fold:
            values = values | {v ^ 32 for v in values if 65 <= (v & ~32) <= 90}
        return frozenset(values)

    def escaped() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def one() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        return escaped() if c == "\\" else ord(c)

    def alternatives():
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence():
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            if pattern[at] == "(":
                at += 1
                part = alternatives()
                at += 1
            elif pattern[at] == "[":
                at += 1
                negated = pattern[at] == "^"
                at += negated
                values: set[int] = set()
                while pattern[at] != "]":
                    low = one()
                    if pattern[at] == "-" and pattern[at + 1] != "]":
                        at += 1
                        values |= set(range(low, one() + 1))
                    else:
                        values.add(low)
                at += 1
                part = ("set", folded(set(range(256)) - values if negated else values))
            else:
                part = ("set", folded({one()}))
            if at < len(pattern) and pattern[at] in "?*+{":
                c = pattern[at]
                at += 1
                if c == "{":
                    end = pattern.index("}", at)
                    least, comma, most = pattern[at:end].partition(",")
                    at = end + 1
                    part = ("rep", part, int(least), int(most) if most else None if comma else int(least))
                else:
                    part = ("rep", part, int(c == "+"), 1 if c == "?" else None)
            parts.append(part)
        return ("cat", parts)

    return alternatives()


def _reversed(tree):
    if tree[0] == "cat":
        return ("cat", [_reversed(x) for x in reversed(tree[1])])
    if tree[0] == "alt":
        return ("alt", [_reversed(x) for x in tree[1]])
    return ("rep", _reversed(tree[1]), *tree[2:]) if tree[0] == "rep" else tree


class _Nfa:
    """State -> list of moves; a move is (bytes, next) or (None, next) for an empty one. State 0 accepts."""

    def __init__(self, tree) -> None:
        self.moves: list[list[tuple[frozenset[int] | None, int]]] = [[]]
        self.start = self._add(tree, 0)

    def _new(self, *moves) -> int:
        self.moves.append(list(moves))
        return len(self.moves) - 1

    def _add(self, tree, then: int) -> int:
        kind = tree[0]
        if kind == "set":
            return self._new((tree[1], then))
        if kind == "cat":
            for part in reversed(tree[1]):
                then = self._add(part, then)
            return then
        if kind == "alt":
            return self._new(*[(None, self._add(x, then)) for x in tree[1]])
        _, part, least, most = tree
        if most is None:
            loop = self._new()
            self.moves[loop] = [(None, self._add(part, loop)), (None, then)]
            then = loop
        else:
            end = then
            for _ in range(most - least):
                then = self._new((None, self._add(part, then)), (None, end))
        for _ in range(least):
            then = self._add(part, then)
        return then

    def closure(self, states) -> tuple[int, ...]:
        """Consuming or accepting states reached without a byte, in order of preference."""
        seen, out = set(), []
        stack = list(reversed(states))
        while stack:
            s = stack.pop()
            if s in seen:
                continue
            seen.add(s)
            if s == 0 or self.moves[s][0][0] is not None:
                out.append(s)
            else:
                stack += [to for _, to in reversed(self.moves[s])]
        return tuple(out)

    def step(self, threads, byte: int) -> tuple[int, ...]:
        return self.closure([to for s in threads if s for on, to in self.moves[s] if byte in on])


def _cut(threads: tuple[int, ...]) -> tuple[int, ...]:
    """A match beats all threads of lower preference."""
    return threads[: threads.index(0) + 1] if 0 in threads else threads


class _Search:
    """One rule's leftmost search, restarting after each match."""

    def __init__(self, nfa: _Nfa) -> None:
        self.nfa, self.fresh = nfa, nfa.closure([nfa.start])

    def move(self, threads: tuple[int, ...], byte: int) -> tuple[int, ...]:
        if 0 in threads:
            if on := _cut(self.nfa.step(threads, byte)):
                if 0 not in on:
                    raise ValueError("a rule must accept until it dies")
                return on
            threads = self.fresh
        on = self.nfa.step(threads, byte)
        return _cut(self.nfa.closure([*on, *self.fresh]))


@dataclass
class Scanner:
    """``next``: state * classes + class -> next state * classes. States from ``accepting`` on accept; ``masks`` says for which rules."""

    rules: list[Rule]
    class_of: np.ndarray
    next: np.ndarray
    classes: int
    start: int
    accepting: int
    masks: np.ndarray
    sync: np.ndarray
    backward: list

    @property
    def states(self) -> int:
        return len(self.next) // self.classes


def _byte_classes(nfas: list[_Nfa]) -> tuple[np.ndarray, list[int]]:
    sets = sorted({on for nfa in nfas for moves in nfa.moves for on, _ in moves if on is not None}, key=sorted)
    seen: dict[tuple, int] = {}
    class_of = np.array([seen.setdefault(tuple(b in s for s in sets), len(seen)) for b in range(256)], dtype=np.uint8)
    return class_of, [int(np.argmax(class_of == k)) for k in range(len(seen))]


def compile_rules(rules: list[Rule]) -> Scanner:
    trees = [_parse(r.pattern, r.ignore_case) for r in rules]
    nfas = [_Nfa(t) for t in trees]
    class_of, examples = _byte_classes(nfas)
    searches = [_Search(n) for n in nfas]
    begin = tuple(s.fresh for s in searches)
    memo: dict[tuple, tuple] = {}
    number, order, rows = {begin: 0}, [begin], []
    for state in order:  # grows while it is read
        row = []
        for b in examples:
            to = []
            for r, threads in enumerate(state):
                key = (r, threads, b)
                if key not in memo:
                    memo[key] = searches[r].move(threads, b)
                to.append(memo[key])
            if (to := tuple(to)) not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        rows.append(row)
    table = np.array(rows)
    masks = np.array([sum(1 << r for r, threads in enumerate(s) if 0 in threads) for s in order])
    block = np.unique(masks, return_inverse=True)[1]
    while True:  # refine until states of a block move to equal blocks on every class
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    first = np.array([int(np.argmax(block == k)) for k in range(block.max() + 1)])
    rank = np.argsort(masks[first] != 0, kind="stable")
    renamed = np.empty_like(rank)
    renamed[rank] = np.arange(len(rank))
    table = renamed[block[table[first[rank]]]]
    masks = masks[first[rank]]
    sync = (table == table[:1]).all(axis=0)[class_of]
    return Scanner(rules, class_of, (table * len(examples)).astype(np.int32).ravel(), len(examples), int(renamed[block[0]]) * len(examples), int(np.argmax(masks != 0)) * len(examples), masks, sync, [_Backward(t) for t in trees])


class _Backward:
    """Anchored automaton of the reversed rule, built as it is used: from a match's end to its leftmost start."""

    def __init__(self, tree) -> None:
        self.nfa = _Nfa(_reversed(tree))
        self.begin = frozenset(self.nfa.closure([self.nfa.start]))
        self.memo: dict[tuple[frozenset, int], frozenset] = {}

    def __getstate__(self):
        return {"nfa": self.nfa, "begin": self.begin, "memo": {}}

    def start(self, data: bytes, low: int, end: int) -> int:
        state, found, at = self.begin, end, end
        while at > low and state:
            at -= 1
            key = (state, data[at])
            if key not in self.memo:
                if len(self.memo) > 100_000:
                    self.memo.clear()
                self.memo[key] = frozenset(self.nfa.step(state, data[at]))
            state = self.memo[key]
            if 0 in state:
                found = at
        return found


def scan(scanner: Scanner, texts: list[bytes], lanes: int = 4096) -> list[list[tuple[int, int, int]]]:
    """For each text the (rule, start, end) byte spans of leftmost non-overlapping matches per rule.

    One pass over the joined bytes: they are cut where a byte leads every state to the same one, and all cuts advance
    together. Texts are joined by a line feed, which must be such a byte.
    """
    if not scanner.sync[10]:
        raise ValueError("a rule can match a line feed")
    data = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(data, dtype=np.uint8)
    starts_at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    safe = np.flatnonzero(scanner.sync[raw])
    wanted = np.arange(1, lanes) * (len(raw) / lanes)
    cuts = np.unique(np.concatenate([[0], safe[np.searchsorted(safe, wanted.astype(np.int64)).clip(0, len(safe) - 1)], [len(raw)]]))
    begin, length = cuts[:-1], np.diff(cuts)
    by_length = np.argsort(-length, kind="stable")
    begin, length = begin[by_length], length[by_length]
    classes = scanner.class_of[raw]
    move, accepting, width = scanner.next, scanner.accepting, scanner.classes
    hits, marks = [], []
    here, state, t = begin.copy(), np.full(len(begin), scanner.start, dtype=np.int32), 0
    active = len(begin)
    while active > 16:
        state = move[state[:active] + classes[here[:active]]]
        if (on := state >= accepting).any():
            hits.append(here[:active][on])
            marks.append(state[on])
        t += 1
        here[:active] += 1
        while active and length[active - 1] <= t:
            active -= 1
    table = move.tolist() if active else []
    for k in range(active):  # few long lanes: byte by byte
        s, found, kept = int(state[k]), [], []
        for i, c in enumerate(classes[int(here[k]) : int(begin[k] + length[k])].tolist(), int(here[k])):
            s = table[s + c]
            if s >= accepting:
                found.append(i)
                kept.append(s)
        hits.append(np.array(found, dtype=np.int64))
        marks.append(np.array(kept, dtype=np.int32))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not hits:
        return out
    hit, mark = np.concatenate(hits), np.concatenate(marks)
    by_place = np.argsort(hit)
    hit, mask = hit[by_place], scanner.masks[mark[by_place] // width]
    for r, rule in enumerate(scanner.rules):
        own = hit[(mask >> r) & 1 == 1]
        if not len(own):
            continue
        heads = np.flatnonzero(np.diff(own, prepend=-2) != 1)
        tails = np.append(heads[1:], len(own)) - 1
        last_end = 0
        for head, tail, text in zip(own[heads].tolist(), own[tails].tolist(), (np.searchsorted(starts_at, own[heads], side="right") - 1).tolist(), strict=True):
            base, end = int(starts_at[text]), tail + 1
            if tail - head + 1 >= rule.min_tail:
                out[text].append((r, scanner.backward[r].start(data, max(base, last_end), end) - base, end - base))
            last_end = end
    return out
