"""A change feed of one table, applied to others in one step for each batch, as a trigger does.

``changes`` compares two states of a table. What a batch does to a target is written to that batch's own folder, which a
replay replaces, and a target is read by folding its folders: nothing is done twice, and a batch that failed half way is
whole after it is run again. ``compact`` folds old batches into one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table
from ..sources.gazette import publish, register
from ..streaming.jobs import finish
from ..tables import new_path


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, op (insert, update, delete), before and after (structs of the row, null where there is none). Keys are unique and not null; equal rows give no change."""
    own = [c for c in before.columns]
    b = before.select(F.col(key).alias("_b"), F.struct(*own).alias("before"))
    a = after.select(F.col(key).alias("_a"), F.struct(*own).alias("after"))
    both = b.join(a, F.col("_a") == F.col("_b"), "full").where(~F.col("before").eqNullSafe(F.col("after")))
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return both.select(F.coalesce("_a", "_b").alias(key), op.alias("op"), "before", "after")


class Target:
    """a table kept by batches of changes, at ``path``: each batch adds what ``step`` makes of the feed, ``fold`` gives the table."""

    def __init__(self, spark: SparkSession, path: str, step: Callable[[DataFrame], DataFrame], fold: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.path, self.step, self.fold = spark, path, step, fold

    def apply(self, feed: DataFrame, batch: int) -> None:
        """Batches are numbered from 1 in order; one applied again replaces itself."""
        self.step(feed).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def table(self) -> DataFrame:
        return self.fold(self.spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*"))

    def compact(self, upto: int) -> None:
        """Fold the batches up to ``upto`` into that one: they can't be replayed afterwards."""
        rows = self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/batch={i}" for i in range(1, upto + 1)])
        self.fold(rows).write.mode("overwrite").parquet(f"{self.path}/folded-{upto}")
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        files = at(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for i in range(1, upto + 1):
            files.delete(at(f"{self.path}/batch={i}"), True)
        files.rename(at(f"{self.path}/folded-{upto}"), at(f"{self.path}/batch={upto}"))


def kept_rows(spark: SparkSession, path: str, key: str, make: Callable[[str], list[Column]], replace: bool = True) -> Target:
    """A target with a row for each key, made of the image after the change; without ``replace`` the first one stays, as an insert that does nothing on conflict leaves it."""

    def step(feed: DataFrame) -> DataFrame:
        gone = F.col("op") == "delete"
        values = F.struct(*make("after"))
        return feed.select(key, gone.alias("_gone"), F.when(~gone, values).alias("_row"))

    def fold(rows: DataFrame) -> DataFrame:
        state = F.struct("_gone", "_row")
        chosen = F.max_by(state, "batch") if replace else F.coalesce(F.min_by(state, F.when(~F.col("_gone"), F.col("batch"))), F.max_by(state, "batch"))
        return rows.groupBy(key).agg(chosen.alias("_s"), F.max("batch").alias("batch")).where("NOT _s._gone").select(key, F.col("_s._gone").alias("_gone"), F.col("_s._row").alias("_row"))

    return Target(spark, path, step, fold)


def rows_of(target: Target) -> DataFrame:
    """The plain rows of ``kept_rows``."""
    t = target.table()
    return t.select(*[c for c in t.columns if not c.startswith("_")], "_row.*")


def totals(spark: SparkSession, path: str, groups: list[str], sums: dict[str, Callable[[str], Column]]) -> Target:
    """A target of sums by group: each change takes its image before away and adds the one after. Groups whose rows are all gone go."""

    def step(feed: DataFrame) -> DataFrame:
        sides = []
        for image, sign in (("before", -1), ("after", 1)):
            side = feed.where(F.col(image).isNotNull())
            sides.append(side.select(*[F.col(f"{image}.{g}").alias(g) for g in groups], F.lit(sign).cast("long").alias("_rows"), *[(f(image) * sign).alias(name) for name, f in sums.items()]))
        return sides[0].unionByName(sides[1]).groupBy(*groups).agg(F.sum("_rows").alias("_rows"), *[F.sum(name).alias(name) for name in sums])

    def fold(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*groups).agg(F.sum("_rows").alias("_rows"), *[F.sum(name).alias(name) for name in sums]).where("_rows > 0")

    return Target(spark, path, step, fold)


def _cents(c: str) -> Column:
    return F.floor(F.col(c) * 100 + 0.5).cast("long")


@query("change_feed", """
WITH urgent AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'), busy AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH'),
c AS (SELECT c_custkey, c_nationkey, c_mktsegment, floor(c_acctbal * 100 + 0.5)::BIGINT + CASE WHEN b.o_custkey IS NOT NULL THEN 1000 ELSE 0 END AS cents, c_name FROM customer LEFT JOIN busy b ON b.o_custkey = c_custkey
  WHERE c_custkey IN (SELECT o_custkey FROM urgent)),
t AS (SELECT c_nationkey, count(*) AS n_rows, sum(cents)::BIGINT AS cents FROM c GROUP BY c_nationkey)
SELECT c_custkey, coalesce(nullif(trim(c_name), ''), 'opositor') AS alias, c.c_nationkey, t.n_rows, t.cents FROM c JOIN t ON t.c_nationkey = c.c_nationkey
""")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers come, change and go in three batches, of which two are applied twice; a profile for each and totals by nation follow."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", _cents("c_acctbal").alias("cents"))
    orders = table(spark, sf_dir, "orders")
    busy = orders.where("o_orderpriority = '2-HIGH'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("more", F.lit(1000))
    richer = customer.join(busy, "c_custkey", "left").withColumn("cents", F.col("cents") + F.coalesce("more", F.lit(0))).drop("more")
    staying = richer.join(orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_semi")
    feeds = [changes(customer.limit(0), customer, "c_custkey"), changes(customer, richer, "c_custkey"), changes(richer, staying, "c_custkey")]
    path = new_path(spark, "feed")
    alias = lambda image: [F.coalesce(F.nullif(F.trim(f"{image}.c_name"), F.lit("")), F.lit("opositor")).alias("alias"), F.col(f"{image}.c_nationkey").alias("c_nationkey")]
    profiles = kept_rows(spark, f"{path}/profiles", "c_custkey", alias)
    nations = totals(spark, f"{path}/nations", ["c_nationkey"], {"cents": lambda image: F.col(f"{image}.cents")})
    for batch in (1, 2, 1, 3, 3):  # 1 and 3 are replayed
        for target in (profiles, nations):
            target.apply(feeds[batch - 1], batch)
    sums = nations.table().select("c_nationkey", F.col("_rows").alias("n_rows"), F.col("cents"))
    return rows_of(profiles).join(sums, "c_nationkey").select("c_custkey", "alias", "c_nationkey", "n_rows", "cents")


@query("gazette_items", """
SELECT ts::DATE::VARCHAR AS day, event_id AS item_id, event_type || ' ' || CAST(props->>'$.k' AS BIGINT) AS title, 's' || user_id % 7 AS section FROM events
WHERE regexp_matches(event_type || ' ' || CAST(props->>'$.k' AS BIGINT), '(purchase|signup|click) ') AND NOT regexp_matches(event_type || ' ' || CAST(props->>'$.k' AS BIGINT), ' [0-9]$')
""")
def gazette_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a gazette's items, published by day and read as a stream whose cursor is the date, in two runs of one query; the items that a run takes."""
    from ..functions.common import json_int

    register(spark)
    e = table(spark, sf_dir, "events")
    items = e.select(F.to_date("ts").cast("string").alias("day"), F.col("event_id").alias("item_id"), F.concat_ws(" ", "event_type", json_int(F.col("props"), "$.k")).alias("title"), F.concat(F.lit("s"), F.col("user_id") % 7).alias("section"))
    path, run = new_path(spark, "gazette"), new_path(spark, "gazette-run")
    read = lambda: spark.readStream.format("gazette").option("include", "(purchase|signup|click) ").option("exclude", " [0-9]$").load(path)
    last = items.agg(F.max("day")).first()[0]
    cut = f"{last[:8]}15" if last else ""
    publish(items.where(F.col("day") <= cut), path)
    finish(read(), "gazette", at=run)
    publish(items.where(F.col("day") > cut), path)
    return finish(read(), "gazette", at=run)
