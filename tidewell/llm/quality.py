"""Quality rules by document and by host, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, join_small, settle

#: A document fails with fewer words, or a larger share of words in repeated windows of WINDOW words.
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8
#: A host is rejected if its failure rate, shrunk towards that of all hosts, is above this.
MAX_HOST_RATE = 0.8
#: Documents that the prior weighs at least: a host with a few documents isn't rejected on their account.
MIN_PRIOR = 20.0
SYMBOLS = r"[#*$%&|<>]"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measures(docs: DataFrame) -> DataFrame:
    """Add the five measures (long) of each whole text; a null text is empty. Columns of these names are replaced.

    Windows are compared by 64-bit hashes within their document: those of a document are sorted with their places, and
    a window is repeated if a neighbour in that order has its hash.
    """
    text, names = F.coalesce("text", F.lit("")), docs.drop(*MEASURES).columns
    words = docs.select(*names, F.array_remove(F.split(text, WORD_GAP), "").alias("_words"))
    # a window's hash is made of its words' hashes: reading these by place costs the same at any length of the text
    windows = F.when(F.size("_hashes") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_hashes") - WINDOW), lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)])))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = words.select(
        *names,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    hashed = counted.select(*names, *MEASURES[:3], "_lines", windows.alias("_windows"))
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = hashed.select(
        *names,
        *MEASURES[:3],
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(some, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_placed"),
    )
    at = lambda k: F.get("_placed", k)["h"]
    twice = F.transform("_placed", lambda x, k: F.when((x["h"] == at(k - 1)) | (x["h"] == at(k + 1)), x["i"]))
    places = placed.select(*names, *MEASURES[:4], F.sort_array(F.filter(twice, lambda i: i.isNotNull())).alias("_places"))
    covered = F.coalesce(_covered("_places"), F.lit(0)).cast("long").alias("n_repeat_words")
    # a row of one element: filters on the measures stay above it, else they would be computed again inside the filters
    return places.select(*names, F.inline(F.array(F.struct(*MEASURES[:4], covered))))


def _covered(places: str) -> Column:
    """Words under windows that begin at sorted places."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"), (i + WINDOW).alias("end"))
    return F.aggregate(places, zero, step, lambda acc: acc["n"])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def host_of(source: str) -> Column:
    """A host's key, which keeps a null source apart from all others."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def host_rates(judged: DataFrame) -> DataFrame:
    """Rows with ``host`` (a key) and ``base_failed`` to one row per host: n, failed, rate (shrunk), rejected.

    The prior is a beta distribution whose mean and variance are those of the hosts' own rates; it weighs as
    MIN_PRIOR documents at least, and as many where these rates don't vary or there is one host.
    """
    hosts = settle(judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("failed")), "hosts")
    own = F.col("failed") / F.col("n")
    mean, spread = hosts.agg(F.avg(own), F.var_samp(own)).first()
    mean = mean or 0.0
    weight = max(MIN_PRIOR, mean * (1 - mean) / spread - 1 if spread else MIN_PRIOR)
    rate = (F.col("failed") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return hosts.withColumn("rate", rate).withColumn("rejected", F.col("rate") > MAX_HOST_RATE)


def rejected_hosts(judged: DataFrame) -> DataFrame:
    """``host`` of rejected hosts and a true ``host_rejected``."""
    return host_rates(judged).where("rejected").select("host", F.lit(True).alias("host_rejected"))


def report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the measures, base_failed, kept (and host_rejected).

    A null text is empty and fails; a null source is a host of its own; repeated rows are judged and counted each.
    Measures are computed once and written; texts aren't moved. Further columns are not read.
    """
    judged = settle(measures(docs.select("doc_id", "text", host_of("source").alias("host"))).select("doc_id", "host", *MEASURES, base_failed().alias("base_failed")), "quality")
    named = join_small(judged, rejected_hosts(judged), "host", "left", width="host")
    bad = F.coalesce("host_rejected", F.lit(False))
    return named.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & ~bad).alias("kept"), bad.alias("host_rejected"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with its columns, whatever their names. Each text is measured once.

    Rows are written with their verdict, as hosts are judged when all documents are; then those of rejected hosts go.
    A null text fails, a null source is a host of its own, repeated rows are judged and counted each.
    """
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")  # so that no column's name clashes with a measure's
    judged = measures(docs.select(own, "text", host_of("source").alias("host")))
    judged = settle(judged.select("_row", "host", base_failed().alias("base_failed")), "judged")
    bad = rejected_hosts(judged.select("host", "base_failed"))
    return join_small(judged.where(~F.col("base_failed")), bad, "host", "left_anti", width="host").select("_row.*")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
windows AS (SELECT rid, unnest(list_transform(range(1, len(ws) - {WINDOW - 2}), lambda i: {{'i': i, 's': array_to_string(ws[i:i + {WINDOW - 1}], ' ')}})) AS x FROM w WHERE len(ws) >= {WINDOW}),
named AS (SELECT rid, x.i AS i, count(*) OVER (PARTITION BY rid, x.s) AS n FROM windows),
covered AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS k FROM named WHERE n > 1) GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
      FROM w LEFT JOIN covered ON w.rid = covered.rid),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS failed FROM j GROUP BY source),
p AS (SELECT avg(failed / n) AS mean, var_samp(failed / n) AS spread FROM h),
q AS (SELECT mean, CASE WHEN spread > 0 THEN greatest({MIN_PRIOR}, mean * (1 - mean) / spread - 1) ELSE {MIN_PRIOR} END AS weight FROM p),
r AS (SELECT source, (failed + mean * weight) / (n + weight) > {MAX_HOST_RATE} AS host_rejected FROM h, q)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT host_rejected AS kept, host_rejected
FROM j JOIN r ON j.source IS NOT DISTINCT FROM r.source
"""
