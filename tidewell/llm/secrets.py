"""Secret scans with one automaton for all rules (see automaton.py)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import Rule, Scanner, compile_rules, scan
from .common import slices

#: The three base rules come first and in this order; min_tail is the least length of what their last group holds.
BASE_KINDS = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, 12),
    Rule("access", r"AKIA[A-Z0-9]+", min_tail=14),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("forge", r"gh[opusr]_[A-Za-z0-9]+", min_tail=36),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", min_tail=10),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", min_tail=8),
    Rule("pem", r"-----BEGIN\x20([A-Z]+\x20)?PRIVATE\x20KEY-----"),
)
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
#: Bytes of text scanned together in a task.
SLICE_BYTES = 4 << 20


@lru_cache(maxsize=4)
def _compiled(rules: tuple[Rule, ...]) -> Scanner:
    return compile_rules(list(rules))


def scanner_for(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return _compiled(rules)


def spans_of(texts: list[str | None], scanner: Scanner | None = None) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) in code points for each text, by start, then rule order."""
    scanner = scanner or scanner_for()
    rules = scanner.rules
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out: list[list[tuple[str, int, int]]] = []
    for begin, end in slices([len(b) for b in raw], SLICE_BYTES):
        for data, found in zip(raw[begin:end], scan(scanner, raw[begin:end]), strict=True):
            if found and not data.isascii():
                points = np.concatenate([[0], np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)])
                found = [(r, int(points[s]), int(points[e])) for r, s, e in found]
            out.append([(rules[r].kind, s, e) for s, r, e in sorted((s, r, e) for r, s, e in found)])
    return out


def with_spans(df: DataFrame, text: str = "text", out: str = "secret_spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the secrets of each whole text as an array of (kind, start, end), code points, end exclusive.

    A null or empty text has none. Rows, repeated or not, are judged alone; other columns pass through untouched, and
    a column that already has the name ``out`` is replaced.
    """
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, SPANS)])
    shipped = df.sparkSession.sparkContext.broadcast(scanner_for(rules))  # about a megabyte, fixed by the rules
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = spans_of(batch.column(text).to_pylist(), shipped.value)
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of the base kinds, the base spans' digest and all spans.

    A null or empty text has no spans and the digest of no bytes; a text of any length is scanned whole; repeated rows
    give equal rows; a null doc_id stays null; an empty table gives no row. Further columns are not read.
    """
    found = with_spans(docs.select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secret_spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secret_spans")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every secret of ``text`` replaced; overlapping spans are masked as one.

    ``n_chars``, where there is such a column, follows the new text. A null text stays null.
    """
    schema, shipped = docs.schema, docs.sparkSession.sparkContext.broadcast(scanner_for(RULES))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else None
            for i, spans in enumerate(spans_of(texts, shipped.value)):
                if spans:
                    texts[i] = masked(texts[i], spans, mask)
                    if counts is not None:
                        counts[i] = len(texts[i])
            new = {"text": texts} | ({"n_chars": counts} if counts is not None else {})
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name) for f in batch.schema], names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    parts, at = [], 0
    for _, start, end in spans:
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in BASE_KINDS).encode()).hexdigest()
