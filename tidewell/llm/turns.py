"""Repair of conversations by the cheapest edits that make their roles ``(s?(ua)+)?``.

A conversation is a string of signs, one a message: its role's initial and its first fault. Over (messages read, state of
the roles so far) the edits are arcs with costs. Minimum costs from the start and to the end say which arcs lie on some
cheapest way, the tight ones; from the start, the set of nodes reached by the least letters so far moves on by the least
letter among its tight arcs.

Messages are numbered over the whole table by a range sort that carries no texts, a fault that needs other messages
(seen earlier) comes from an aggregation by digest, and only signs come together by conversation, as the audit of the
result does. Texts move once to their edits, by number, and once to their conversation, where the hash is a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import number_rows
from .common import forget, scratch, settle

#: Costs of the edits; what a truncated message costs beside its edit if it stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: Messages of which signs are put together first; messages between two stored columns of costs.
BLOCK, STRIDE = 256, 1024

# States: nothing yet, after system, after user, after assistant. The next state by a role's initial; where roles may end.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: In each state one of user and assistant may follow: what an insertion or a new role must be.
ROLE = ["user", "user", "assistant", "user"]
ENDS = (0, 3)
FAULTS = "-bdt"  # none, blank, duplicate, truncated


def sign(initial: Column, fault: Column) -> Column:
    """One character for a message: role initials s, u, a and any other, and the four faults."""
    row = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.char(F.lit(65) + row * 4 + fault)


def read(sign: str) -> tuple[str, str]:
    n = ord(sign) - 65
    return "sua."[n // 4], FAULTS[n % 4]


@lru_cache(maxsize=None)
def _arcs(sign: str) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state, arcs that read a message: letter, cost, next state, in the order of letters."""
    initial, fault = read(sign)
    out = []
    for q in range(4):
        arcs = [("D", DELETE, q)]
        if fault not in "bd":
            more = TRUNCATED if fault == "t" else 0
            if (q, initial) in NEXT:
                arcs.append(("K", KEEP + more, NEXT[q, initial]))
            arcs.append(("R", REROLE + more, NEXT[q, ROLE[q][0]]))
        out.append(tuple(arcs))
    return tuple(out)


_INSERTED = [NEXT[q, ROLE[q][0]] for q in range(4)]


def _with_inserts(costs: list[float], back: bool) -> list[float]:
    """Costs after any insertions between two messages; three are the most that a cheapest way can use."""
    for _ in range(3):
        if back:
            costs = [min(costs[q], costs[_INSERTED[q]] + INSERT) for q in range(4)]
        else:
            costs = [min([costs[q], *(costs[p] + INSERT for p in range(4) if _INSERTED[p] == q)]) for q in range(4)]
    return costs


def _forward(costs: list[float], sign: str) -> list[float]:
    """From the costs of the nodes before a message, insertions made, to those after it."""
    out = [float("inf")] * 4
    for q, arcs in enumerate(_arcs(sign)):
        for _, cost, to in arcs:
            out[to] = min(out[to], costs[q] + cost)
    return _with_inserts(out, back=False)


def _backward(costs: list[float], sign: str) -> list[float]:
    return _with_inserts([min(cost + costs[to] for _, cost, to in arcs) for arcs in _arcs(sign)], back=True)


def repair(signs: str) -> tuple[int, str]:
    """Least cost, and of the cheapest edits' letters in order the ASCII-least.

    Costs are stored for every ``STRIDE``-th message and computed again between, so that memory is a few bytes a message.
    """
    n = len(signs)
    first = _with_inserts([0.0, *[float("inf")] * 3], back=False)
    last = _with_inserts([0.0 if q in ENDS else float("inf") for q in range(4)], back=True)
    backs = {n: last}
    costs = last
    for i in range(n - 1, -1, -1):
        costs = _backward(costs, signs[i])
        if i % STRIDE == 0:
            backs[i] = costs
    total = costs[0]
    letters: list[str] = []
    forward, frontier = first, {0}
    for begin in range(0, n + 1, STRIDE):
        stop = min(begin + STRIDE, n)
        near = [backs[stop]]
        for i in range(stop - 1, begin - 1, -1):
            near.append(_backward(near[-1], signs[i]))
        near.reverse()  # near[i - begin]: costs from before message i to the end
        for i in range(begin, stop + 1 if stop == n else stop):
            here = near[i - begin]
            while True:  # insertions, then the message
                tight: list[tuple[str, int]] = []
                for q in frontier:
                    if forward[q] + INSERT + here[_INSERTED[q]] == total:
                        tight.append(("I", _INSERTED[q]))
                    if i < n:
                        after = near[i + 1 - begin] if i + 1 - begin < len(near) else backs[i + 1]
                        tight += [(letter, to) for letter, cost, to in _arcs(signs[i])[q] if forward[q] + cost + after[to] == total]
                if not tight:
                    break  # the end
                least = min(letter for letter, _ in tight)
                frontier = {to for letter, to in tight if letter == least}
                letters.append(least)
                if least != "I":
                    break
            if i < n:
                forward = _forward(forward, signs[i])
    return int(total), "".join(letters)


@lru_cache(maxsize=20_000)
def _repair(signs: str) -> tuple[int, str]:
    """Short conversations are much alike."""
    return repair(signs)


def edits(signs: str, audit: str) -> Iterator[tuple[str, str, str, str]]:
    """For each message: roles inserted before it (initials), its letter, its new role ('' where it keeps its own), roles inserted after it if it's the last."""
    q, at = 0, 0
    n = len(signs)
    for i in range(n):
        before = ""
        while audit[at] == "I":
            before += ROLE[q][0]
            q, at = _INSERTED[q], at + 1
        letter = audit[at]
        at += 1
        role = ROLE[q] if letter == "R" else ""
        if letter != "D":
            q = NEXT[q, ROLE[q][0] if letter == "R" else read(signs[i])[0]]
        after = ""
        if i == n - 1:
            while at < len(audit):
                after += ROLE[q][0]
                q, at = _INSERTED[q], at + 1
        yield before, letter, role, after


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of ``conv_id:turn`` chooses; a null in role or text, or in what is hashed, is one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).cast("int")
    r = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("_kind")).where("_kind != 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return r.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def _signs(messages: DataFrame) -> DataFrame:
    """_id, conv_id, turn, at (number over the table, by conversation and turn), sign of messages that have an ``_id``.

    No text is sorted or counted: a digest of role and text stands for it. Copies of one row are spread by their ids.
    """
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    light = messages.select(
        "_id", "conv_id", "turn", digest.alias("digest"), F.left("role", F.lit(1)).alias("initial"),
        F.when(end == "", 1).when(F.right(end, F.lit(1)).isin(".", "!", "?"), 0).otherwise(3).alias("fault"),
    )
    numbered = number_rows(light, ["conv_id", "turn", "digest", "_id"], "at")
    earliest = numbered.groupBy("conv_id", "digest").agg(F.min("at").alias("first")).select(F.col("first").alias("at"), F.lit(True).alias("new"))
    marked = numbered.join(earliest, "at", "left")  # by a unique number: no key is hot
    fault = F.when((F.col("fault") != 1) & F.col("new").isNull(), 2).otherwise(F.col("fault"))
    return marked.select("_id", "conv_id", "turn", "at", sign(F.col("initial"), fault).alias("sign"))


_SUMMARY = "conv_id {}, at long, signs string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audited(signs: DataFrame) -> DataFrame:
    """One row for each conversation that has messages: signs in order, counts of faults, cost and audit."""
    one = signs.groupBy("conv_id", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "sign"))).alias("m"))
    parts = one.select("conv_id", F.element_at("m", 1)["at"].alias("at"), F.array_join(F.col("m.sign"), "").alias("signs"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "signs"))).alias("m"))  # a byte a message
    rows = whole.select("conv_id", F.element_at("m", 1)["at"].alias("at"), F.array_join(F.col("m.signs"), "").alias("signs"))
    schema = T._parse_datatype_string(_SUMMARY.format(signs.schema["conv_id"].dataType.simpleString()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in batch.column("signs").to_pylist():
                faults = [FAULTS[(ord(x) - 65) % 4] for x in s]
                initials = [read(x)[0] for x in s]
                illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
                cost, audit = _repair(s) if len(s) <= 64 else repair(s)
                out.append((faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _decisions(summary: DataFrame) -> DataFrame:
    """at, before, letter, new_role, after of each message."""
    schema = T._parse_datatype_string("at long, before string, letter string, new_role string, after string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 5, [pa.int64(), *[pa.string()] * 4], strict=True)], names=schema.names)

        rows: list[tuple] = []
        for batch in batches:
            for at, signs, audit in zip(*[batch.column(c).to_pylist() for c in ("at", "signs", "audit")], strict=True):
                for i, edit in enumerate(edits(signs, audit)):
                    rows.append((at + i, *edit))
                    if len(rows) >= 8192:
                        yield made(rows)
                        rows = []
        yield made(rows)

    return summary.select("at", "signs", "audit").mapInArrow(run, schema)


def _settled(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages after damage with an id, their signs and the conversations' summaries, in the shared folder."""
    messages = settle(damaged(rows).withColumn("_id", F.monotonically_increasing_id()), "messages")
    with scratch():
        signs = settle(_signs(messages), "signs", keep=True)
    return messages, signs, settle(audited(signs), "audits")


def _repaired(messages: DataFrame, signs: DataFrame, summary: DataFrame) -> DataFrame:
    edited = signs.select("_id", "at").join(_decisions(summary), "at").where("letter != 'D' OR before != '' OR after != ''")
    inserted = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.struct(F.when(x == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))
    own = F.array(F.struct(F.when(F.col("new_role") == "", F.col("role")).otherwise(F.col("new_role")).alias("role"), F.col("text").alias("text"), F.col("letter").alias("edit")))
    own = F.filter(own, lambda m: m["edit"] != "D")
    return messages.join(edited, "_id").select("conv_id", "at", F.concat(inserted("before"), own, inserted("after")).alias("messages"))


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role, text, edit (K, R or I) of the repaired conversations' messages."""
    m = number_rows(_repaired(*_settled(rows)).select("conv_id", "at", F.posexplode("messages").alias("inner", "m")), ["conv_id", "at", "inner"], "n")
    begins = m.groupBy(F.col("conv_id").alias("_key")).agg(F.min("n").alias("first"))
    return m.join(begins, F.col("conv_id").eqNullSafe(F.col("_key"))).select("conv_id", (F.col("n") - F.col("first")).alias("position"), "m.role", "m.text", "m.edit")


def _hashes(messages: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: a conversation's messages are read in order as a stream, as this hash can't be divided."""
    schema = T.StructType([messages.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    line = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    rows = messages.select("conv_id", "at", line.alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "at")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, digest = False, hashlib.sha256()
        key = None
        for batch in batches:
            keys: list = []
            hashes: list[str] = []
            for k, text in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if open_ and k == key:
                    digest.update(b"\n")
                elif open_:
                    keys.append(key)
                    hashes.append(digest.hexdigest())
                if not open_ or k != key:
                    open_, key, digest = True, k, hashlib.sha256()
                digest.update(text.encode())
            kind = batch.schema.field("conv_id").type
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(hashes, pa.string())], names=schema.names)
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([digest.hexdigest()], pa.string())], names=schema.names)

    return rows.select("conv_id", "line").mapInArrow(run, schema)


def report(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of ``rows``.

    ``rows`` has conv_id, turn, role, text; a null conv_id is a conversation. Messages of one turn are in the order of a
    digest of role and text, so copies are neighbours; of equal messages all but the first are duplicates. Without
    messages after the damage, or after the repair, the hash is that of no bytes. A role that begins with none of s, u
    and a, or is empty, can't be kept. A very long conversation needs a few bytes a message in one task, as its audit
    does, and its texts pass through a stream. Further columns are not read; an empty table gives no row. Gaps beyond a
    long are null.
    """
    rows = rows.select("conv_id", "turn", "role", "text")
    messages, signs, summary = _settled(rows)
    hashes = settle(_hashes(_repaired(messages, signs, summary)), "repaired")
    forget(messages)
    by_turn = signs.groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    width = F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.count("turn")
    gaps = by_turn.groupBy("conv_id").agg(F.coalesce(width.cast("decimal(20,0)"), F.lit(0)).alias("wide")).select("conv_id", F.expr("try_cast(wide AS bigint)").alias("gaps"))
    out = rows.select("conv_id").distinct()
    for side in (gaps, summary.drop("at", "signs"), hashes):
        side = side.withColumnRenamed("conv_id", "_key")
        out = out.join(side, F.col("conv_id").eqNullSafe(F.col("_key")), "left").drop("_key")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    no_gaps = F.when(F.col("cost").isNull(), F.lit(0).cast("long")).otherwise(F.col("gaps")).alias("gaps")
    empty = hashlib.sha256().hexdigest()
    return out.select("conv_id", no_gaps, *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
