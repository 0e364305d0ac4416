"""Mixing sources to target weights by Poisson replication.

A source that should hold the share w of the mixture and holds the share s now is repeated w / s times on average.
Each document's count is the inverse of that Poisson distribution at a number that hashes of seed and doc_id give, so
that it is the same in any run and at any number of partitions. Copies are then put in a global random order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, settle

SEED = "mix-1"
#: Without given weights, a source's target is its share of bytes to this power, scaled to add up to 1.
TEMPERATURE = 0.7
#: Up to this rate exp(-rate) is far from the smallest double.
LARGE = 700.0
#: Bytes of rows that one partition of the mixture holds, and of a row without its text.
PARTITION, ROW = 256 << 20, 64


def uniform(*columns: Column) -> Column:
    """A number in [0, 1) of 52 bits from the columns' md5."""
    digest = F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_start(rate: Column) -> Column:
    """The count from which the distribution is tabled: 0, or for rates above LARGE twelve deviations and more below the mean."""
    return F.when(rate > LARGE, F.floor(rate - 12 * F.sqrt(rate) - 40)).otherwise(F.lit(0)).cast("int")


def poisson_steps(rate: Column) -> Column:
    """The distribution function at ``poisson_start``, the next count and so on, as far as double precision tells it from 1."""
    begin, reach = poisson_start(rate), (rate + 12 * F.sqrt(rate) + 40).cast("int")
    m = F.greatest(begin, F.lit(1)).cast("double")  # exp(-rate) is zero for large rates; there Stirling's series gives the first term
    first = F.when(begin > 0, F.exp(m - rate + m * F.log(rate / m) - 0.5 * F.log(2 * math.pi * m) - 1 / (12 * m) + 1 / (360 * m * m * m))).otherwise(F.exp(-rate))
    zero = F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + p)).alias("all"))

    return F.aggregate(F.sequence(begin + 1, reach), zero, step, lambda acc: acc["all"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per source: mix_source (a null one is kept apart), documents, bytes, target, rate and the steps of its distribution.

    Shares are of UTF-8 bytes plus one a document. Sources outside given ``weights`` have the target 0 and go.
    """
    sizes = docs.groupBy(_key("source").alias("mix_source")).agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("bytes"), F.count(F.lit(1)).alias("documents"))
    sizes = settle(sizes, "sizes")
    if weights is None:
        wish = F.pow(F.col("bytes"), F.lit(TEMPERATURE))
    else:
        if any(w < 0 or math.isnan(w) for w in weights.values()) or not sum(weights.values()):
            raise ValueError("weights must not be negative and one must be positive")
        wish = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, w in weights.items() for x in ("=" + k, float(w))]), F.col("mix_source")), F.lit(0.0)) if weights else F.lit(0.0)
    wished = sizes.withColumn("wish", wish)
    total, wishes = wished.agg(F.sum("bytes"), F.sum("wish")).first()
    target = F.col("wish") / F.lit(float(wishes or 1))
    rate = target * F.lit(float(total or 0)) / F.col("bytes")
    return wished.select("mix_source", "documents", "bytes", target.alias("target"), rate.alias("rate")).withColumn("steps", poisson_steps(F.col("rate")))


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))


def identity() -> Column:
    """What a row's number is made of: its doc_id, or without one a digest of source and text, so that such rows are told apart."""
    content = F.md5(F.concat_ws("|", F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))))
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none:"), content))


def copies(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Rows of ``docs`` with n_copies and mix_rate added, before anything is repeated; columns of these names are replaced.

    Rows that repeat a doc_id in a source get equal counts, as do equal rows without one. The table of sources with
    their distributions is broadcast if all its numbers fit 4 MB, and is joined by a shuffle beyond.
    """
    return _counted(docs, _known(docs, weights))


def _known(docs: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    return settle(rates(docs, weights).withColumnRenamed("rate", "mix_rate"), "rates")


def _counted(docs: DataFrame, known: DataFrame) -> DataFrame:
    known = known.select("mix_source", "mix_rate", "steps")
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), _key("source").alias("mix_source"), uniform(identity()).alias("_u"))
    named = join_small(own, known, "mix_source", "left", max_bytes=4 << 20, width="steps")
    n = (poisson_start(F.col("mix_rate")) + F.size(F.filter("steps", lambda x: x <= F.col("_u")))).cast("int")
    return named.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in ("mix_rate", "n_copies")], F.col("mix_rate"), n.alias("n_copies"))


def partitions(known: DataFrame, texts: bool) -> int:
    """Ranges of the mixture: as many as the session shuffles into, and more where one would hold over PARTITION bytes on average.

    A source's rows are repeated ``mix_rate`` times, so that the table of sources gives what the mixture will hold.
    """
    each = F.col("documents") * ROW + (F.col("bytes") if texts else 0)
    expected = known.agg(F.sum(each * F.col("mix_rate"))).first()[0] or 0
    return max(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(expected / PARTITION))


def in_order(keyed: DataFrame, n: int) -> DataFrame:
    """Global order by mix_key in ``n`` partitions. Its hashes are uniform, so that equal ranges are equal partitions and nothing is sampled first."""
    return keyed.repartitionById(n, F.floor(F.col("mix_key") * n).cast("int")).sortWithinPartitions("mix_key", *[c for c in ("_tie", "source") if c in keyed.columns])


def mix(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Each row of ``docs`` as often as its count says, in a global order by a hash of doc_id and copy; columns of ``docs`` only.

    A null source is a source of its own, a null text has one byte, an empty table stays empty. Copies of rows that
    repeat a doc_id have equal keys; among them the order follows a hash of the row, and equal rows are alike.
    """
    known = _known(docs, weights)
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    counted = _counted(docs.select(own, "doc_id", "source", "text", F.xxhash64("source", "text").alias("_tie")), known)
    spread = counted.where("n_copies > 0").select("_row", "_tie", identity().alias("_id"), F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    keyed = spread.withColumn("mix_key", uniform(F.col("_id"), F.col("copy")))
    return in_order(keyed, partitions(known, True)).select("_row.*")


def report(docs: DataFrame) -> DataFrame:
    """One row per copy: doc_id, source, copy, n_copies, mix_key; the mixture is their order by mix_key.

    A null source is one of its own; a null text has one byte, a very long one its length; rows of one doc_id have one
    number and so equal counts, rows without any have that of their source and text; an empty table gives no row.
    Further columns are not read.
    """
    known = _known(docs, None)
    counted = _counted(docs.select("doc_id", "source", "text"), known).where("n_copies > 0")
    spread = counted.select("doc_id", identity().alias("_id"), "source", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    return in_order(spread.withColumn("mix_key", uniform(F.col("_id"), F.col("copy"))), partitions(known, False)).drop("_id")


SQL = f"""
WITH RECURSIVE s AS (SELECT source, sum(strlen(coalesce(text, '')) + 1)::DOUBLE AS bytes FROM documents GROUP BY source),
r AS (SELECT source, pow(bytes, {TEMPERATURE}) / (SELECT sum(pow(bytes, {TEMPERATURE})) FROM s) * (SELECT sum(bytes) FROM s) / bytes AS rate FROM s),
starts AS (SELECT source, rate, CASE WHEN rate > {LARGE} THEN floor(rate - 12 * sqrt(rate) - 40) ELSE 0 END::INTEGER AS k FROM r),
first AS (SELECT *, CASE WHEN k > 0 THEN exp(k - rate + k * ln(rate / k) - 0.5 * ln(2 * pi() * k) - 1 / (12.0 * k) + 1 / (360.0 * k * k * k)) ELSE exp(-rate) END AS p FROM starts),
steps AS (SELECT source, rate, k AS start, k, p, p AS total FROM first
          UNION ALL SELECT source, rate, start, k + 1, p * rate / (k + 1), total + p * rate / (k + 1) FROM steps WHERE k < rate + 12 * sqrt(rate) + 40),
i AS (SELECT *, coalesce(doc_id::VARCHAR, 'none:' || md5(coalesce(source, '') || '|' || coalesce(text, ''))) AS id FROM documents),
d AS (SELECT row_number() OVER () AS rid, doc_id, id, source, ('0x' || substr(md5('{SEED}|' || id), 1, 13))::BIGINT / pow(2, 52) AS u FROM i),
n AS (SELECT d.rid, any_value(d.doc_id) AS doc_id, any_value(d.id) AS id, any_value(d.source) AS source, any_value(start) + count(*) FILTER (WHERE steps.total <= d.u) AS n_copies
      FROM d JOIN steps ON d.source IS NOT DISTINCT FROM steps.source GROUP BY d.rid),
e AS (SELECT doc_id, id, source, n_copies, unnest(range(1, n_copies + 1)) AS copy FROM n)
SELECT doc_id, source, n_copies::INTEGER AS n_copies, copy::INTEGER AS copy,
       ('0x' || substr(md5('{SEED}|' || id || '|' || copy), 1, 13))::BIGINT / pow(2, 52) AS mix_key FROM e
"""
