"""Distinct counts by sketches that are kept a day and merged for any window, with exact twins beside them.

A day's table of sketches has a row for each group of that day, a few kilobytes at most, whatever the day's events were.
Days are partitions that are replaced whole, so a day computed again changes nothing; a window reads its days alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import json_int
from ..registry import query, table
from ..tables import new_path

#: Logarithm of a sketch's size. The relative standard error of a count is 1.04 / 2^(PRECISION / 2), 1.6 per cent.
PRECISION = 12
ERROR = 1.04 / 2 ** (PRECISION / 2)


def daily(events: DataFrame, groups: list[str], who: str) -> DataFrame:
    """Day, groups, visitors (sketch for unions), members (sketch for intersections) of ``events`` with ts. A null ``who`` isn't counted."""
    return events.groupBy(F.to_date("ts").alias("day"), *groups).agg(F.hll_sketch_agg(who, PRECISION).alias("visitors"), F.theta_sketch_agg(who, PRECISION).alias("members"))


def store(sketches: DataFrame, path: str) -> None:
    """Write days into the table at ``path``: those that are there already are replaced."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def trailing(sketches: DataFrame, groups: list[str], days: int) -> DataFrame:
    """Sketches of every day's window of ``days`` days up to it, for days that have events of the group."""
    last = sketches.select(*groups, "day").distinct()
    each = sketches.withColumn("until", F.explode(F.sequence(F.col("day"), F.date_add("day", days - 1))))
    merged = each.groupBy(*groups, F.col("until").alias("day")).agg(F.hll_union_agg("visitors").alias("visitors"), F.theta_union_agg("members").alias("members"))
    return merged.join(last, [*groups, "day"], "left_semi")


def near(estimate: Column, exact: Column, errors: float = 4.0) -> Column:
    """Whether an estimate is within so many standard errors of the count, or one unit."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), exact * errors * ERROR)


def exact_trailing(events: DataFrame, groups: list[str], who: str, days: int) -> DataFrame:
    """The exact twin of ``trailing``: groups, day, n; a person counts once for every window that holds one of their days."""
    seen = events.select(*groups, F.to_date("ts").alias("day"), who).distinct()
    each = seen.withColumn("until", F.explode(F.sequence(F.col("day"), F.date_add("day", days - 1))))
    counts = each.select(*groups, F.col("until").alias("day"), who).distinct().groupBy(*groups, "day").agg(F.count(who).alias("n"))
    return counts.join(seen.select(*groups, "day").distinct(), [*groups, "day"], "left_semi")


@query("weekly_visitors_by_sketch", """
WITH v AS (SELECT DISTINCT CAST(props->>'$.k' AS BIGINT) % 20 AS landing, ts::DATE AS day, user_id FROM events WHERE event_type = 'view'), d AS (SELECT DISTINCT landing, day FROM v)
SELECT d.landing, d.day, count(DISTINCT user_id) AS n, true AS near FROM d JOIN v ON v.landing = d.landing AND v.day BETWEEN d.day - 6 AND d.day GROUP BY d.landing, d.day
""")
def weekly_visitors_by_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visitors of each landing in the seven days up to each day; the sketches' estimate is held against the exact count."""
    views = table(spark, sf_dir, "events").where("event_type = 'view'").withColumn("landing", json_int(F.col("props"), "$.k") % 20)
    path = new_path(spark, "sketches")
    store(daily(views, ["landing"], "user_id"), path)
    week = trailing(spark.read.parquet(path), ["landing"], 7).select("landing", "day", F.hll_sketch_estimate("visitors").alias("estimate"))
    both = exact_trailing(views, ["landing"], "user_id", 7).join(week, ["landing", "day"], "left")
    return both.select("landing", "day", "n", F.coalesce(near(F.col("estimate"), F.col("n")), F.lit(False)).alias("near"))


@query("funnel_by_sketch", """
WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events), u AS (SELECT DISTINCT event_type, ts::DATE AS day, user_id FROM events WHERE event_type IN ('view', 'signup', 'purchase')),
w AS (SELECT d.day, user_id, bool_or(event_type = 'view') AS v, bool_or(event_type = 'signup') AS s, bool_or(event_type = 'purchase') AS p FROM d JOIN u ON u.day BETWEEN d.day - 6 AND d.day GROUP BY d.day, user_id)
SELECT day, count(*) FILTER (WHERE v) AS visited, count(*) FILTER (WHERE v AND s) AS registered, count(*) FILTER (WHERE v AND s AND p) AS bought, true AS near FROM w GROUP BY day
""")
def funnel_by_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A funnel of the seven days up to each day, where a step's people are an intersection of the steps' sketches, held against the exact counts."""
    steps = ("view", "signup", "purchase")
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin(*steps))
    path = new_path(spark, "sketches")
    store(daily(e, ["event_type"], "user_id"), path)
    stored = spark.read.parquet(path)
    each = stored.withColumn("until", F.explode(F.sequence(F.col("day"), F.date_add("day", 6))))
    wide = each.groupBy(F.col("until").alias("day")).agg(*[F.theta_union_agg(F.when(F.col("event_type") == s, F.col("members"))).alias(s) for s in steps])
    both = F.theta_intersection("view", "signup")
    sketched = wide.select("day", F.theta_sketch_estimate("view").alias("e1"), F.theta_sketch_estimate(both).alias("e2"), F.theta_sketch_estimate(F.theta_intersection(both, F.col("purchase"))).alias("e3"), F.theta_sketch_estimate(F.theta_union("view", "signup")).alias("union"))
    seen = e.select("event_type", F.to_date("ts").alias("day"), "user_id").distinct().withColumn("until", F.explode(F.sequence(F.col("day"), F.date_add("day", 6))))
    did = [F.bool_or(F.col("event_type") == s) for s in steps]
    people = seen.groupBy(F.col("until").alias("day"), "user_id").agg(did[0].alias("v"), did[1].alias("s"), did[2].alias("p"))
    exact = people.groupBy("day").agg(F.count_if("v").alias("visited"), F.count_if(F.expr("v AND s")).alias("registered"), F.count_if(F.expr("v AND s AND p")).alias("bought"))
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    x = exact.join(days, "day", "left_semi").join(sketched, "day", "left")
    slack = F.greatest(F.lit(1.0), F.col("union") * 4 * ERROR)  # an intersection's error grows with the union
    fine = [F.abs(F.col(a) - F.col(b)) <= slack for a, b in (("e1", "visited"), ("e2", "registered"), ("e3", "bought"))]
    return x.select("day", "visited", "registered", "bought", F.coalesce(fine[0] & fine[1] & fine[2], F.lit(False)).alias("near"))
