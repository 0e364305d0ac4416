"""Learner analytics over ordered events: streaks, repetition, mastery, comparisons, scores, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import AS_OF_SQL, as_of, half_up, json_int
from ..registry import query, table

#: Days to the next review by streak of right answers (fixed values).
INTERVALS = (0, 1, 3, 7, 16, 35)
#: A wrong answer's share of a point that it costs.
PENALTY = 1 / 3


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers: the item is k modulo 20, a click, signup or purchase is right."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "ts", (json_int(F.col("props"), "$.k") % 20).alias("item"), F.col("event_type").isin("click", "signup", "purchase").alias("correct"))


_ANSWERS = "a AS (SELECT event_id, user_id, ts, CAST(props->>'$.k' AS BIGINT) % 20 AS item, event_type IN ('click', 'signup', 'purchase') AS correct FROM events)"


def item_states(a: DataFrame) -> DataFrame:
    """Per user and item right and wrong answers, the streak since the last wrong one, last times.

    The fold over time needs no order within the aggregate: the streak is the right answers after the last wrong one,
    which a second pass over the same grouping counts.
    """
    w = Window.partitionBy("user_id", "item").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = a.withColumn("fails", F.count_if(~F.col("correct")).over(w))
    most = Window.partitionBy("user_id", "item")
    return (
        run.withColumn("all_fails", F.max("fails").over(most))
        .groupBy("user_id", "item")
        .agg(
            F.count_if("correct").alias("ok"),
            F.count_if(~F.col("correct")).alias("ko"),
            F.count_if(F.col("correct") & (F.col("fails") == F.col("all_fails"))).alias("streak"),
            F.max("ts").alias("last_ts"),
            F.max(F.when(~F.col("correct"), F.col("ts"))).alias("last_fail_ts"),
        )
    )


def state_of(ok: Column, ko: Column, streak: Column) -> Column:
    """New, failed, learned or mastered."""
    return F.when(ok + ko == 0, "new").when(streak == 0, "failed").when(streak >= 3, "mastered").otherwise("learned")


_STATES = f"""{_ANSWERS}, f AS (SELECT *, count(*) FILTER (WHERE NOT correct) OVER (PARTITION BY user_id, item ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS fails FROM a),
g AS (SELECT *, max(fails) OVER (PARTITION BY user_id, item) AS all_fails FROM f),
st AS (SELECT user_id, item, count(*) FILTER (WHERE correct) AS ok, count(*) FILTER (WHERE NOT correct) AS ko, count(*) FILTER (WHERE correct AND fails = all_fails) AS streak,
       max(ts) AS last_ts, max(ts) FILTER (WHERE NOT correct) AS last_fail_ts FROM g GROUP BY user_id, item),
sx AS (SELECT *, CASE WHEN streak = 0 THEN 'failed' WHEN streak >= 3 THEN 'mastered' ELSE 'learned' END AS state FROM st)"""


def next_review(last: Column, streak: Column) -> Column:
    """The last answer and the interval of the streak."""
    days = F.element_at(F.array(*[F.lit(d) for d in INTERVALS]), F.least(streak, F.lit(len(INTERVALS) - 1)).cast("int") + 1)
    return last + F.make_dt_interval(days)


@query("spaced_repetition", f"""
WITH {_STATES} SELECT user_id, item, ok, ko, streak, state, last_fail_ts, last_ts + INTERVAL 1 DAY * ([0, 1, 3, 7, 16, 35])[least(streak, 5) + 1] AS due,
       last_ts + INTERVAL 1 DAY * ([0, 1, 3, 7, 16, 35])[least(streak, 5) + 1] <= {AS_OF_SQL} AS overdue FROM sx
""")
def spaced_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learning state of each item and when it is due."""
    a = answers(spark, sf_dir)
    s = item_states(a).withColumn("due", next_review(F.col("last_ts"), F.col("streak")))
    return s.select("user_id", "item", "ok", "ko", "streak", state_of(F.col("ok"), F.col("ko"), F.col("streak")).alias("state"), "last_fail_ts", "due", (F.col("due") <= as_of(a)).alias("overdue"))


@query("review_order", f"""
WITH {_STATES}, d AS (SELECT *, last_ts + INTERVAL 1 DAY * ([0, 1, 3, 7, 16, 35])[least(streak, 5) + 1] AS due FROM sx),
o AS (SELECT user_id, item, state, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN due <= {AS_OF_SQL} THEN 0 ELSE 1 END, CASE WHEN due <= {AS_OF_SQL} THEN due END NULLS FIRST, CASE state WHEN 'failed' THEN 0 WHEN 'learned' THEN 1 ELSE 2 END, item) AS position FROM d)
SELECT user_id, item, state, position FROM o WHERE position <= 5
""")
def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: what is due first by its time, then by state; the first five of each user."""
    a = answers(spark, sf_dir)
    s = item_states(a).withColumn("due", next_review(F.col("last_ts"), F.col("streak"))).withColumn("state", state_of(F.col("ok"), F.col("ko"), F.col("streak")))
    late = F.col("due") <= as_of(a)
    order = Window.partitionBy("user_id").orderBy(F.when(late, 0).otherwise(1), F.when(late, F.col("due")).asc_nulls_first(), F.when(F.col("state") == "failed", 0).when(F.col("state") == "learned", 1).otherwise(2), "item")
    return s.withColumn("position", F.row_number().over(order).cast("long")).where("position <= 5").select("user_id", "item", "state", "position")


@query("mastery_stats", f"""
WITH {_STATES} SELECT item % 4 AS topic, count(*) AS n_items, count(*) FILTER (WHERE state = 'mastered') AS mastered, count(*) FILTER (WHERE state = 'failed') AS failed,
       round(100.0 * sum(CASE state WHEN 'mastered' THEN 100 WHEN 'learned' THEN 60 ELSE 0 END) / (100 * count(*)), 2) AS dominance,
       round(10.0 * sum(CASE state WHEN 'mastered' THEN 95 WHEN 'learned' THEN 70 ELSE 10 END) / (100 * count(*)), 2) AS expected_mark FROM sx GROUP BY topic
""")
def mastery_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mastery and the expected mark of each topic from its items' states."""
    s = item_states(answers(spark, sf_dir)).withColumn("state", state_of(F.col("ok"), F.col("ko"), F.col("streak")))
    points = lambda m, k, f: F.sum(F.when(F.col("state") == "mastered", m).when(F.col("state") == "learned", k).otherwise(f))
    n = F.count(F.lit(1))
    return s.groupBy((F.col("item") % 4).alias("topic")).agg(n.alias("n_items"), F.count_if(F.col("state") == "mastered").alias("mastered"), F.count_if(F.col("state") == "failed").alias("failed"), F.round(100.0 * points(100, 60, 0).cast("double") / (100 * n), 2).alias("dominance"), F.round(10.0 * points(95, 70, 10).cast("double") / (100 * n), 2).alias("expected_mark"))


@query("mistake_list", f"""
WITH {_STATES} SELECT user_id, item, ko, state = 'failed' AS pending FROM sx WHERE ko > 0
""")
def mistake_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that were ever wrong, and whether they still are."""
    s = item_states(answers(spark, sf_dir)).where("ko > 0")
    return s.select("user_id", "item", "ko", (F.col("streak") == 0).alias("pending"))


@query("topic_priority", f"""
WITH {_STATES}, t AS (SELECT user_id, item % 4 AS topic, count(*) AS n, sum(CASE state WHEN 'mastered' THEN 100 WHEN 'learned' THEN 60 ELSE 0 END) / count(*) AS pct, count(*) FILTER (WHERE state = 'failed') AS fails FROM sx GROUP BY ALL)
SELECT user_id, topic, round((100 - pct) / 100 * ln(1 + n) + 2 * 1.5 * fails / n, 6) AS priority FROM t
""")
def topic_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is missing, weighted by the topic's size, and an urgency for failures."""
    s = item_states(answers(spark, sf_dir)).withColumn("state", state_of(F.col("ok"), F.col("ko"), F.col("streak")))
    n = F.count(F.lit(1))
    pct = F.sum(F.when(F.col("state") == "mastered", 100).when(F.col("state") == "learned", 60).otherwise(0)) / n
    return s.groupBy("user_id", (F.col("item") % 4).alias("topic")).agg(F.round((100 - pct) / 100 * F.log(1 + n) + 2 * 1.5 * F.count_if(F.col("state") == "failed").cast("double") / n, 6).alias("priority"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day as a practice session: answers, right, wrong, blank (views)."""
    e = table(spark, sf_dir, "events")
    kind = lambda *k: F.count_if(F.col("event_type").isin(*k))
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), kind("click", "signup", "purchase").alias("ok"), kind("error").alias("ko"), kind("view").alias("blank"))


_SESSIONS = "s AS (SELECT user_id, ts::DATE AS day, count(*) AS n, count(*) FILTER (WHERE event_type IN ('click', 'signup', 'purchase')) AS ok, count(*) FILTER (WHERE event_type = 'error') AS ko, count(*) FILTER (WHERE event_type = 'view') AS blank FROM events GROUP BY ALL)"


def penalised(ok: Column, ko: Column, n: Column, pen: float = PENALTY) -> Column:
    """The mark out of ten, a wrong answer costing ``pen``, not below zero, one decimal, halves up."""
    return F.floor(F.greatest(F.lit(0.0), (ok - ko * F.lit(pen)) / n * 10) * 10 + 0.5) / 10


_MARK = "floor(greatest(0.0, (ok - ko * 0.3333333333333333::DOUBLE) / n * 10) * 10 + 0.5) / 10"


@query("penalised_score", f"WITH {_SESSIONS} SELECT user_id, day, n, ok, ko, blank, {_MARK} AS mark FROM s")
def penalised_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of all sessions."""
    return sessions(spark, sf_dir).withColumn("mark", penalised(F.col("ok"), F.col("ko"), F.col("n")))


@query("mock_compare", f"""
WITH {_SESSIONS}, m AS (SELECT user_id, day, {_MARK} AS mark, lag({_MARK}) OVER w AS before, sum(floor({_MARK} * 10 + 0.5)::BIGINT) OVER (PARTITION BY user_id) AS tenths, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n_sessions FROM s WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, n_sessions, mark AS last_mark, round(mark - before, 1) AS difference, floor(tenths * 10.0::DOUBLE / n_sessions + 0.5) / 100 AS mean_mark FROM m WHERE r = 1
""")
def mock_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last session against the one before and the mean."""
    s = sessions(spark, sf_dir).withColumn("mark", penalised(F.col("ok"), F.col("ko"), F.col("n")))
    last = s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.slice(F.sort_array(F.collect_list(F.struct("day", "mark")), asc=False), 1, 2).alias("two"), F.sum(half_up(F.col("mark") * 10)).alias("tenths"))
    now, before = F.get("two", 0)["mark"], F.get("two", 1)["mark"]
    return last.select("user_id", "n_sessions", now.alias("last_mark"), F.round(now - before, 1).alias("difference"), (F.floor(F.col("tenths") * 10.0 / F.col("n_sessions") + 0.5) / 100).alias("mean_mark"))


@query("streaks", f"""
WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), g AS (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INTEGER AS island FROM d),
i AS (SELECT user_id, island, count(*) AS n, max(day) AS last_day FROM g GROUP BY ALL)
SELECT user_id, max(n) AS longest, coalesce(max(n) FILTER (WHERE last_day >= {AS_OF_SQL}::DATE - 2), 0) AS current_streak FROM i GROUP BY user_id
""")
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of days; a run is current if it ends on the last day or the day before."""
    e = table(spark, sf_dir, "events")
    days = e.select("user_id", F.to_date("ts").alias("day")).distinct()
    w = Window.partitionBy("user_id").orderBy("day")
    islands = days.withColumn("island", F.date_sub("day", F.row_number().over(w))).groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("last_day"))
    current = F.col("last_day") >= F.date_sub(as_of(e).cast("date"), 2)
    return islands.groupBy("user_id").agg(F.max("n").alias("longest"), F.coalesce(F.max(F.when(current, F.col("n"))), F.lit(0)).alias("current_streak"))


@query("points_level", f"""
WITH {_SESSIONS}, p AS (SELECT user_id, sum(n) AS n, sum(ok) AS ok, count(DISTINCT day) AS days FROM s WHERE day >= {AS_OF_SQL}::DATE - 7 GROUP BY user_id),
q AS (SELECT user_id, (floor(100 * ok / n + 0.5) + least(n, 50) + 10 * days)::BIGINT AS points FROM p)
SELECT user_id, points, (1 + (points >= 60)::INT + (points >= 100)::INT + (points >= 140)::INT + (points >= 180)::INT)::INTEGER AS level FROM q
""")
def points_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the last seven days from precision, volume (at most 50) and days, and the level they reach."""
    s = sessions(spark, sf_dir)
    since = F.date_sub(as_of(table(spark, sf_dir, "events")).cast("date"), 7)
    p = s.where(F.col("day") >= since).groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"), F.count(F.lit(1)).alias("days"))
    points = half_up(100 * F.col("ok") / F.col("n")) + F.least("n", F.lit(50)) + 10 * F.col("days")
    q = p.select("user_id", points.cast("long").alias("points"))
    return q.withColumn("level", 1 + F.size(F.filter(F.array(*[F.lit(x) for x in (60, 100, 140, 180)]), lambda x: x <= F.col("points"))))


@query("time_split", f"""
WITH {_STATES}, t AS (SELECT user_id, item % 4 AS topic, sum(CASE state WHEN 'mastered' THEN 100 WHEN 'learned' THEN 60 ELSE 0 END) / count(*) AS pct FROM sx GROUP BY ALL),
w AS (SELECT *, CASE WHEN pct < 50 THEN 1.5 WHEN pct < 75 THEN 1.0 ELSE 0.6 END::DOUBLE AS weight FROM t)
SELECT user_id, topic, floor(600 * weight / sum(weight) OVER (PARTITION BY user_id) + 0.5)::BIGINT AS minutes FROM w
""")
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """600 weekly minutes, shared by how weak a topic is."""
    s = item_states(answers(spark, sf_dir)).withColumn("state", state_of(F.col("ok"), F.col("ko"), F.col("streak")))
    pct = F.sum(F.when(F.col("state") == "mastered", 100).when(F.col("state") == "learned", 60).otherwise(0)) / F.count(F.lit(1))
    t = s.groupBy("user_id", (F.col("item") % 4).alias("topic")).agg(pct.alias("pct")).withColumn("weight", F.when(F.col("pct") < 50, 1.5).when(F.col("pct") < 75, 1.0).otherwise(0.6))
    return t.select("user_id", "topic", half_up(600 * F.col("weight") / F.sum("weight").over(Window.partitionBy("user_id"))).alias("minutes"))


#: Least seconds for 1 to 9 points of a timed test, slower first, and the time that 10 points must beat (fixed values of the example scale).
CUTS = (90.0, 80.0, 70.0, 60.0, 50.0, 40.0, 30.0, 20.0, 10.0, 5.0)


def scale_points(value: Column, cuts: tuple[float, ...] = CUTS) -> Column:
    """The last cut that a falling scale's value reaches; the last one must be beaten."""
    reached = F.filter(F.transform(F.array(*[F.lit(c) for c in cuts]), lambda c, i: F.when((value < c) | ((value == c) & (i < len(cuts) - 1)), i + 1)), lambda x: x.isNotNull())
    return F.coalesce(F.array_max(reached), F.lit(0))


@query("scale_lookup", """
WITH b AS (SELECT user_id, min(value) AS best, arg_max(value, (ts, event_id)) AS latest FROM events GROUP BY user_id),
p AS (SELECT *, coalesce(list_max(list_transform(range(1, 11), lambda i: CASE WHEN latest < ([90.0, 80, 70, 60, 50, 40, 30, 20, 10, 5])[i] OR (latest = ([90.0, 80, 70, 60, 50, 40, 30, 20, 10, 5])[i] AND i < 10) THEN i END)), 0)::INTEGER AS points FROM b)
SELECT user_id, best, latest, points, points >= 5 AS passed FROM p
""")
def scale_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test's best and latest marks and the latest one's points."""
    b = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("value").alias("best"), F.max_by("value", F.struct("ts", "event_id")).alias("latest"))
    return b.withColumn("points", scale_points(F.col("latest"))).withColumn("passed", F.col("points") >= 5)


def footrule(order: Column, ideal: Column) -> Column:
    """Ten times one minus the footrule distance of two orders of four over its largest value, eight."""
    apart = F.aggregate(F.transform(order, lambda x, i: F.abs(F.array_position(ideal, x) - 1 - i)), F.lit(0).cast("long"), lambda a, x: a + x)
    return 10 * (1 - apart / 8)


@query("footrule_score", """
WITH t AS (SELECT user_id, list(item ORDER BY n DESC, item) AS o FROM (SELECT user_id, CAST(props->>'$.k' AS BIGINT) % 4 AS item, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id HAVING count(*) = 4)
SELECT user_id, 10 * (1 - list_sum(list_transform(range(0, 4), lambda i: abs(o[i + 1] - i))) / 8) AS score FROM t
""")
def footrule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near a user's order of four topics, by activity, is to the given one."""
    n = table(spark, sf_dir, "events").groupBy("user_id", (json_int(F.col("props"), "$.k") % 4).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    order = n.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "item"))), lambda x: x["item"]).alias("o")).where(F.size("o") == 4)
    return order.select("user_id", footrule(F.col("o"), F.array(*[F.lit(i).cast("long") for i in range(4)])).alias("score"))


@query("self_assessment", """
WITH v AS (SELECT user_id, event_id % 2 = 1 AS inverted, 1 + event_id % 5 AS value FROM events), w AS (SELECT user_id, inverted, CASE WHEN inverted THEN 6 - value ELSE value END AS v FROM v),
m AS (SELECT user_id, avg(v) AS mean, avg(v) FILTER (WHERE inverted) AS i, avg(v) FILTER (WHERE NOT inverted) AS d FROM w GROUP BY user_id)
SELECT user_id, round(mean, 4) AS mean_value, round(100 - 25 * abs(i - d), 4) AS consistency FROM m
""")
def self_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted items count from the other end; the two kinds' difference gives the consistency."""
    e = table(spark, sf_dir, "events")
    v = e.select("user_id", (F.col("event_id") % 2 == 1).alias("inverted"), (1 + F.col("event_id") % 5).alias("value")).withColumn("v", F.when(F.col("inverted"), 6 - F.col("value")).otherwise(F.col("value")))
    m = v.groupBy("user_id").agg(F.avg("v").alias("mean"), F.avg(F.when(F.col("inverted"), F.col("v"))).alias("i"), F.avg(F.when(~F.col("inverted"), F.col("v"))).alias("d"))
    return m.select("user_id", F.round("mean", 4).alias("mean_value"), F.round(100 - 25 * F.abs(F.col("i") - F.col("d")), 4).alias("consistency"))


@query("strength_last_ten", """
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, round(avg(value) FILTER (WHERE r <= 10), 4) AS strength, round(avg(value) FILTER (WHERE r <= 5) - avg(value) FILTER (WHERE r > 5), 4) AS trend FROM r WHERE r <= 10 GROUP BY user_id
""")
def strength_last_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the last ten values and how the last five differ from those before."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    r = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).where("r <= 10")
    part = lambda c: F.avg(F.when(c, F.col("value")))
    return r.groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("strength"), F.round(part(F.col("r") <= 5) - part(F.col("r") > 5), 4).alias("trend"))


@query("psychometric_groups", f"""
WITH {_ANSWERS} SELECT item % 4 AS category, item % 3 AS difficulty, grouping(item % 4, item % 3)::BIGINT AS grouped, count(*) AS n, count(*) FILTER (WHERE correct) AS ok,
       count(*) >= 4 AND 100 * count(*) FILTER (WHERE correct) < 60 * count(*) AS recurring FROM a GROUP BY GROUPING SETS ((item % 4), (item % 3), (item % 4, item % 3))
""")
def psychometric_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by category, by difficulty and by both in one pass; recurring errors below 60 per cent of four and more."""
    a = answers(spark, sf_dir).select((F.col("item") % 4).alias("category"), (F.col("item") % 3).alias("difficulty"), "correct")
    c, d = F.col("category"), F.col("difficulty")
    g = a.groupingSets([[c], [d], [c, d]], c, d).agg(F.grouping_id().alias("grouped"), F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("ok"))
    return g.withColumn("recurring", (F.col("n") >= 4) & (100 * F.col("ok") < 60 * F.col("n")))
