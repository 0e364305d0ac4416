"""A learner's preparation and the state of a catalogue: plans, adaptive levels, readiness, gaps, batches, checklists, access."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import json_int
from ..registry import query, table
from .items import _LIST, _known, made_items, _MADE_SQL

#: Shares of a day's free minutes, and minutes that a question takes (fixed values).
SHARES = {"review": 0.35, "weak": 0.35, "new": 0.2, "hard": 0.1}
MINUTES_EACH = 1.5


@query("counts_as_object", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, to_json(map_from_entries(list((event_type, n) ORDER BY event_type)))::VARCHAR AS counts FROM c GROUP BY user_id")
def counts_as_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events by type as one JSON object, in the order of its keys."""
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n"))))).alias("counts"))


@query("map_functions", "WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), m AS (SELECT c_nationkey, map_from_entries(list((c_mktsegment, n) ORDER BY c_mktsegment)) AS m FROM c GROUP BY c_nationkey) SELECT c_nationkey, array_to_string(list_sort(map_keys(m)), ',') AS segments, list_sum(map_values(m))::BIGINT AS n, m['BUILDING'] AS building, cardinality(m)::INTEGER AS n_segments FROM m")
def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map functions: keys, values, lookup and size of maps built from groups."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    m = c.groupBy("c_nationkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c_mktsegment", "n")))).alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x)
    return m.select("c_nationkey", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("segments"), total.alias("n"), F.try_element_at("m", F.lit("BUILDING")).alias("building"), F.size("m").alias("n_segments"))


@query("daily_pick", "WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events), s AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents), f AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS k, count(*) OVER () AS m FROM (SELECT DISTINCT source FROM documents)), o AS (SELECT day, (day - DATE '1970-01-01')::BIGINT + 719163 AS ordinal FROM d)\nSELECT day, f.source, doc_id FROM o JOIN f ON k = ordinal % m JOIN s ON s.source = f.source AND r = ordinal % n")
def daily_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's source and item of it, by the day's ordinal number modulo how many there are. Only chosen sources are numbered."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct().withColumn("ordinal", F.unix_date("day").cast("long") + 719163)
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source", "doc_id")
    sizes = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    named = sizes.withColumn("k", F.row_number().over(Window.orderBy("source")) - 1).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy()))  # one row per source
    chosen = days.join(named, F.col("k") == F.pmod("ordinal", "m")).select("day", "source", F.pmod("ordinal", "n").alias("r"))
    items = d.join(chosen.select("source").distinct(), "source").withColumn("r", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("long"))
    return chosen.join(items, ["source", "r"]).select("day", "source", "doc_id")


@query("topic_order", "WITH t AS (SELECT p_size AS topic, count(*) FILTER (WHERE p_brand = 'Brand#1') AS n, 30 AS target, min(p_partkey) % 4 AS prio FROM part GROUP BY p_size) SELECT topic, n, row_number() OVER (ORDER BY n > 0, n / greatest(1, target), prio, topic) AS place FROM t WHERE target - n > 0")
def topic_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics that lack items, in the order of having none, coverage, priority and place in the syllabus."""
    t = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("topic")).agg(F.count_if(F.col("p_brand") == "Brand#1").alias("n"), (F.min("p_partkey") % 4).alias("prio")).where("n < 30")
    order = Window.orderBy(F.col("n") > 0, F.col("n") / 30, "prio", "topic")  # one row per topic
    return t.select("topic", "n", F.row_number().over(order).cast("long").alias("place"))


def adaptive_level(answers: Column) -> Column:
    """Answers (booleans in order) to a struct n, ok, dif, run: up after two hits in a row, down on a miss, between 1 and 3."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("ok"), F.lit(1).alias("dif"), F.lit(0).alias("run"))

    def step(s: Column, hit: Column) -> Column:
        run = F.when(hit, s["run"] + 1).otherwise(0)
        up = hit & (run >= 2) & (s["dif"] < 3)
        dif = F.when(up, s["dif"] + 1).when(~hit & (s["dif"] > 1), s["dif"] - 1).otherwise(s["dif"])
        return F.struct((s["n"] + 1).alias("n"), (s["ok"] + hit.cast("int")).alias("ok"), dif.alias("dif"), F.when(up, 0).otherwise(run).alias("run"))

    return F.aggregate(answers, zero, step)


@query("adaptive_difficulty", """WITH RECURSIVE a AS (SELECT user_id, event_type IN ('click', 'purchase') AS hit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('click', 'purchase', 'error')),
s(user_id, i, n, ok, dif, run) AS (SELECT DISTINCT user_id, 0::BIGINT, 0, 0, 1, 0 FROM a UNION ALL SELECT s.user_id, a.i, n + 1, ok + hit::INT, CASE WHEN hit AND run + 1 >= 2 AND dif < 3 THEN dif + 1 WHEN NOT hit AND dif > 1 THEN dif - 1 ELSE dif END, CASE WHEN NOT hit THEN 0 WHEN run + 1 >= 2 AND dif < 3 THEN 0 ELSE run + 1 END FROM s JOIN a ON a.user_id = s.user_id AND a.i = s.i + 1)
SELECT user_id, n, ok, dif, run FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def adaptive_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each learner's answers lead; a learner's answers are one array."""
    a = table(spark, sf_dir, "events").where("event_type IN ('click', 'purchase', 'error')").select("user_id", F.struct("ts", "event_id", F.col("event_type").isin("click", "purchase").alias("hit")).alias("a"))
    folded = a.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("a")), lambda x: x["hit"]).alias("hits"))
    return folded.select("user_id", adaptive_level(F.col("hits")).alias("s")).select("user_id", "s.*")


def today(learners: DataFrame) -> DataFrame:
    """A learner's plan for the day: questions of each kind and minutes.

    ``hours`` a week (1 to 60, 6 if unknown) are spread over ``days``; a mock exam of ``mock_minutes`` is due after
    ``every`` days since the last (``since``, null: none), with 30 answers and enough minutes. Free minutes go by SHARES:
    to what is ``due``, to up to three ``weak`` topics of five questions or more, to ``new`` and to ``hard`` ones; what is
    left goes to new ones.
    """
    hours = F.greatest(F.lit(1.0), F.least(F.lit(60.0), F.coalesce("hours", F.lit(6.0))))
    minutes = F.greatest(F.lit(10), F.floor(hours * 60 / F.col("days") + 0.5))
    mock = (F.col("answers") >= 30) & (F.col("since").isNull() | (F.col("since") >= F.col("every"))) & (minutes >= F.col("mock_minutes"))
    free = F.greatest(F.lit(0), minutes - F.when(mock, F.col("mock_minutes")).otherwise(0))
    quota = lambda kind: F.floor(free * SHARES[kind] / MINUTES_EACH)
    n_weak = F.least(F.col("weak"), F.lit(3))
    p = learners.select("*", minutes.alias("minutes"), mock.alias("mock"), free.alias("free"), F.least("due", quota("review")).alias("review"), F.when(n_weak > 0, n_weak * F.greatest(F.lit(5), F.floor(quota("weak") / n_weak))).otherwise(0).alias("weak_questions"), F.least("new", quota("new")).alias("some_new"), F.least("hard", quota("hard")).alias("hard_questions"))
    used = (F.col("review") + F.col("weak_questions") + F.col("some_new") + F.col("hard_questions")) * MINUTES_EACH
    left = F.floor((F.col("free") - used) / MINUTES_EACH)
    p = p.withColumn("new_questions", F.when(left > 0, F.least(F.col("new"), F.col("some_new") + left)).otherwise(F.col("some_new")))
    total = (F.col("review") + F.col("weak_questions") + F.col("new_questions") + F.col("hard_questions")) * MINUTES_EACH + F.when(F.col("mock"), F.col("mock_minutes")).otherwise(0)
    long = lambda *names: [F.col(n).cast("long").alias(n) for n in names]
    return p.select("id", "mock", *long("review", "weak_questions", "new_questions", "hard_questions"), F.floor(F.least(F.col("minutes"), total) + 0.5).cast("long").alias("recommended"))


_LEARNERS = {"id": "c_custkey", "hours": "CASE WHEN c_custkey % 13 <> 0 THEN CAST(c_custkey % 71 AS DOUBLE) END", "days": "1 + c_custkey % 7", "mock_minutes": "60", "every": "CASE c_custkey % 3 WHEN 0 THEN 7 WHEN 1 THEN 3 ELSE 5 END", "since": "CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 11 END", "answers": "c_custkey % 90", "due": "c_custkey % 37", "weak": "c_custkey % 6", "new": "c_custkey % 101", "hard": "c_custkey % 9"}


@query("today_plan", f"""WITH l AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _LEARNERS.items())} FROM customer), m AS (SELECT *, greatest(10, floor(greatest(1.0::DOUBLE, least(60.0::DOUBLE, coalesce(hours, 6.0::DOUBLE))) * 60 / days + 0.5)) AS minutes FROM l),
k AS (SELECT *, answers >= 30 AND (since IS NULL OR since >= every) AND minutes >= mock_minutes AS mock FROM m), f AS (SELECT *, greatest(0, minutes - CASE WHEN mock THEN mock_minutes ELSE 0 END) AS free, least(weak, 3) AS nw FROM k),
q AS (SELECT *, least(due, floor(free * 0.35::DOUBLE / 1.5::DOUBLE)) AS review, CASE WHEN nw > 0 THEN nw * greatest(5, floor(floor(free * 0.35::DOUBLE / 1.5::DOUBLE) / nw)) ELSE 0 END AS weak_questions, least(new, floor(free * 0.2::DOUBLE / 1.5::DOUBLE)) AS some_new, least(hard, floor(free * 0.1::DOUBLE / 1.5::DOUBLE)) AS hard_questions FROM f),
n AS (SELECT *, floor((free - (review + weak_questions + some_new + hard_questions) * 1.5) / 1.5) AS over FROM q), z AS (SELECT *, CASE WHEN over > 0 THEN least(new, some_new + over) ELSE some_new END AS new_questions FROM n)
SELECT id, mock, review::BIGINT AS review, weak_questions::BIGINT AS weak_questions, new_questions::BIGINT AS new_questions, hard_questions::BIGINT AS hard_questions, floor(least(minutes, (review + weak_questions + new_questions + hard_questions) * 1.5 + CASE WHEN mock THEN mock_minutes ELSE 0 END) + 0.5)::BIGINT AS recommended FROM z""")
def today_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example learners' plans for a day."""
    return today(table(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {n}" for n, e in _LEARNERS.items()]))


@query("achievements", """WITH u AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'signup') AS sessions, count(*) AS answers, count(DISTINCT ts::DATE) AS days, count(*) FILTER (WHERE event_type = 'purchase') AS mastered, round(10.0 * count(*) FILTER (WHERE event_type = 'click') / count(*), 4) AS mark, count(*) FILTER (WHERE event_type = 'error') AS unseen FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_filter([CASE WHEN sessions >= 1 THEN 'first test' END, CASE WHEN answers >= 100 THEN '100 answers' END, CASE WHEN days >= 3 THEN '3 days' END, CASE WHEN days >= 7 THEN '7 days' END, CASE WHEN mastered >= 25 THEN '25 mastered' END, CASE WHEN mark >= 5 THEN 'pass' END, CASE WHEN mark >= 9 THEN 'excellent' END, CASE WHEN unseen = 0 THEN 'all seen' END], lambda x: x IS NOT NULL), ',') AS achieved,
  least(7, greatest(3, floor((user_id % 12) / 1.5 + 0.5)))::BIGINT AS goal_days, days >= least(7, greatest(3, floor((user_id % 12) / 1.5 + 0.5))) AND 10 * mark >= 20 AS goal_met FROM u""")
def achievements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight achievements, and whether a week's goal of days and precision is met."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(n("signup").alias("sessions"), F.count(F.lit(1)).alias("answers"), F.countDistinct(F.to_date("ts")).alias("days"), n("purchase").alias("mastered"), F.round(10.0 * n("click").cast("double") / F.count(F.lit(1)), 4).alias("mark"), n("error").alias("unseen"))
    got = _known((F.col("sessions") >= 1, "first test"), (F.col("answers") >= 100, "100 answers"), (F.col("days") >= 3, "3 days"), (F.col("days") >= 7, "7 days"), (F.col("mastered") >= 25, "25 mastered"), (F.col("mark") >= 5, "pass"), (F.col("mark") >= 9, "excellent"), (F.col("unseen") == 0, "all seen"))
    goal = F.least(F.lit(7), F.greatest(F.lit(3), F.floor((F.col("user_id") % 12) / 1.5 + 0.5))).cast("long")
    return u.select("user_id", F.array_join(got, ",").alias("achieved"), goal.alias("goal_days"), ((F.col("days") >= goal) & (10 * F.col("mark") >= 20)).alias("goal_met"))


@query("weighted_exam", """WITH m AS (SELECT o_custkey, o_orderkey % 4 AS test, max(floor(o_totalprice) % 11) AS points FROM orders GROUP BY ALL), t AS (SELECT o_custkey, count(*) = 4 AS complete, sum(points * CASE test WHEN 0 THEN 40 WHEN 1 THEN 30 WHEN 2 THEN 20 ELSE 10 END) / 100 AS total, min(points) AS least FROM m GROUP BY o_custkey)
SELECT o_custkey, complete, CASE WHEN complete THEN round(total, 2) END AS total, CASE WHEN complete THEN least >= 1 AND round(total, 2) >= 5 END AS passes FROM t""")
def weighted_exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted total of all tests, which must all be there, against the minima of each and of the whole."""
    m = table(spark, sf_dir, "orders").groupBy("o_custkey", (F.col("o_orderkey") % 4).alias("test")).agg(F.max(F.floor("o_totalprice") % 11).cast("double").alias("points"))
    weight = F.when(F.col("test") == 0, 40).when(F.col("test") == 1, 30).when(F.col("test") == 2, 20).otherwise(10)
    t = m.groupBy("o_custkey").agg((F.count(F.lit(1)) == 4).alias("complete"), F.round(F.sum(F.col("points") * weight) / 100, 2).alias("sum"), F.min("points").alias("least"))
    return t.select("o_custkey", "complete", F.when(F.col("complete"), F.col("sum")).alias("total"), F.when(F.col("complete"), (F.col("least") >= 1) & (F.col("sum") >= 5)).alias("passes"))


#: Modules of a preparation: how many valid items make one ready, and how many make it usable.
MODULES = {"literal": (60, 20), "plazos": (60, 20), "negativa": (40, 10), "excepcion": (40, 10), "caso": (250, 30)}


@query("readiness_matrix", f"""WITH {_MADE_SQL}, r(kind, target, usable) AS (VALUES {', '.join(f"('{k}', {a}, {b})" for k, (a, b) in MODULES.items())}), n AS (SELECT kind, count(*) FILTER (WHERE id % 3 <> 0) AS valid, count(*) FILTER (WHERE id % 3 = 0) AS review, count(DISTINCT difficulty) AS levels, min(k) AS least FROM (SELECT *, count(*) OVER (PARTITION BY kind, difficulty) AS k FROM m) GROUP BY kind)
SELECT r.kind, coalesce(valid, 0) AS valid, coalesce(review, 0) AS review, greatest(0, target - coalesce(valid, 0))::BIGINT AS missing, CASE WHEN coalesce(valid, 0) >= target THEN 'READY' WHEN coalesce(valid, 0) >= usable THEN 'PARTIAL' ELSE 'EMPTY' END AS state, CASE WHEN coalesce(valid, 0) < 3 THEN 'P0' WHEN coalesce(valid, 0) < target THEN 'P1' ELSE 'P3' END AS priority, levels, least FROM r LEFT JOIN n ON n.kind = r.kind""")
def readiness_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each module's valid items against its target, what is missing, its state and priority, and the fewest items of a level."""
    counts = made_items(spark, sf_dir).select("kind", "difficulty", (F.col("id") % 3 != 0).alias("valid")).groupBy("kind", "difficulty").agg(F.count(F.lit(1)).alias("k"), F.count_if("valid").alias("v"))
    n = counts.groupBy("kind").agg(F.sum("v").alias("valid"), F.sum(F.col("k") - F.col("v")).alias("review"), F.count(F.lit(1)).alias("levels"), F.min("k").alias("least"))
    r = spark.createDataFrame([(k, a, b) for k, (a, b) in MODULES.items()], "kind string, target long, usable long")
    x = r.join(n, "kind", "left").fillna(0, ["valid", "review"])
    state = F.when(F.col("valid") >= F.col("target"), "READY").when(F.col("valid") >= F.col("usable"), "PARTIAL").otherwise("EMPTY")
    priority = F.when(F.col("valid") < 3, "P0").when(F.col("valid") < F.col("target"), "P1").otherwise("P3")
    return x.select("kind", "valid", "review", F.greatest(F.lit(0).cast("long"), F.col("target") - F.col("valid")).alias("missing"), state.alias("state"), priority.alias("priority"), "levels", "least")


@query("batch_plan", f"""WITH {_MADE_SQL}, g AS (SELECT law, kind, 40 - count(*) AS missing, count(*) AS n, max(id % 5) AS tries FROM m GROUP BY ALL), o AS (SELECT *, CASE WHEN n < 10 THEN 0 WHEN missing > 12 THEN 1 ELSE 2 END AS priority FROM g WHERE missing > 0 AND kind <> 'otro'),
b AS (SELECT *, row_number() OVER (ORDER BY priority, kind, law) AS place FROM o) SELECT place, law, kind, missing, 'P' || priority AS priority, sha256(law || '|' || kind || '|' || n) AS fingerprint, tries >= 4 AS exhausted FROM b WHERE place <= 20""")
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next twenty batches by priority, kind and law, with a fingerprint of what they were planned on, and whether their section is used up."""
    g = made_items(spark, sf_dir).groupBy("law", "kind").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("id") % 5).alias("tries")).withColumn("missing", 40 - F.col("n")).where("missing > 0 AND kind <> 'otro'")
    o = g.withColumn("p", F.when(F.col("n") < 10, 0).when(F.col("missing") > 12, 1).otherwise(2)).orderBy("p", "kind", "law").limit(20)
    return o.select(F.row_number().over(Window.orderBy("p", "kind", "law")).cast("long").alias("place"), "law", "kind", "missing", F.concat(F.lit("P"), "p").alias("priority"), F.sha2(F.concat_ws("|", "law", "kind", "n"), 256).alias("fingerprint"), (F.col("tries") >= 4).alias("exhausted"))


@query("checklist_progress", "WITH c AS (SELECT user_id, CAST(props->>'$.k' AS BIGINT) % 12 AS task, event_id FROM events WHERE event_type = 'click'), n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'view'), t AS (SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY r) AS notes FROM n WHERE r <= 5 GROUP BY user_id)\nSELECT c.user_id, count(DISTINCT task) AS done, 12 AS total, any_value(coalesce(notes, '')) AS last_notes FROM c LEFT JOIN t ON t.user_id = c.user_id GROUP BY c.user_id")
def checklist_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks done of all, and the last five notes, latest first."""
    e = table(spark, sf_dir, "events")
    done = e.where("event_type = 'click'").groupBy("user_id").agg(F.countDistinct(json_int(F.col("props"), "$.k") % 12).alias("done"))
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = e.where("event_type = 'view'").withColumn("r", F.row_number().over(w)).where("r <= 5").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col("event_id").cast("string").alias("e")))), lambda x: x["e"]), ",").alias("notes"))
    return done.join(last, "user_id", "left").select("user_id", "done", F.lit(12).alias("total"), F.coalesce("notes", F.lit("")).alias("last_notes"))


@query("coverage_labels", "WITH t AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, count(*) FILTER (WHERE n >= 10) AS tested, count(*) FILTER (WHERE n BETWEEN 1 AND 9) AS partly, 4 - count(*) AS empty, CASE WHEN round(100.0 * sum(least(n, 30)) / 120, 4) >= 75 THEN 'UTILIZABLE' ELSE 'PARCIAL' END AS label FROM t GROUP BY source")
def coverage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label by how complete a set is, and its topics with ten items, with some, with none."""
    t = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.round(100.0 * F.sum(F.least("n", F.lit(30))).cast("double") / 120, 4)
    return t.groupBy("source").agg(F.count_if(F.col("n") >= 10).alias("tested"), F.count_if(F.col("n").between(1, 9)).alias("partly"), (4 - F.count(F.lit(1))).alias("empty"), F.when(share >= 75, "UTILIZABLE").otherwise("PARCIAL").alias("label"))


# ---- access

#: Columns that are not published.
PRIVATE = ("value", "props")


def secured(df: DataFrame, user: str, is_admin: bool = False, owner: str = "user_id") -> DataFrame:
    """P5: what ``user`` may see of a table: their own rows, an administrator all. Views are made with this filter, so it can't be left out."""
    return df if is_admin else df.where(F.col(owner).cast("string") == F.lit(user))


def published(df: DataFrame, private: tuple[str, ...] = PRIVATE) -> DataFrame:
    """A table without its private columns."""
    return df.drop(*private)


def gated(flags: dict[str, bool], name: str, build: Callable[[], DataFrame], schema: str) -> Callable[[SparkSession], DataFrame]:
    """A report that is empty while its flag is off."""
    return lambda spark: build() if flags.get(name, False) else spark.createDataFrame([], schema)


@query("own_rows", "SELECT event_id, ts, user_id, event_type FROM events WHERE user_id = 7")
def own_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user's rows, published columns only, behind a flag."""
    e = table(spark, sf_dir, "events")
    return gated({"history": True}, "history", lambda: published(secured(e, "7")), "event_id long")(spark)


SCALARS = {
    "is_admin": "CREATE OR REPLACE TEMPORARY FUNCTION is_admin(role STRING) RETURNS BOOLEAN RETURN coalesce(role = 'admin', false)",
    "service_or_admin": "CREATE OR REPLACE TEMPORARY FUNCTION service_or_admin(role STRING) RETURNS BOOLEAN RETURN coalesce(role IN ('service', 'admin'), false)",
    "plan_of": "CREATE OR REPLACE TEMPORARY FUNCTION plan_of(spent DOUBLE) RETURNS STRING RETURN CASE WHEN spent >= 400 THEN 'pro' WHEN spent > 0 THEN 'basic' ELSE 'free' END",
    "referral_code": "CREATE OR REPLACE TEMPORARY FUNCTION referral_code(id BIGINT) RETURNS STRING RETURN substr(md5(concat('ref|', id)), 1, 8)",
}


@query("scalar_functions", "WITH u AS (SELECT user_id, CASE user_id % 9 WHEN 0 THEN 'admin' WHEN 1 THEN 'service' WHEN 2 THEN 'user' END AS role, round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS spent FROM events GROUP BY user_id) SELECT user_id, coalesce(role = 'admin', false) AS is_admin, coalesce(role IN ('service', 'admin'), false) AS trusted, CASE WHEN spent >= 400 THEN 'pro' WHEN spent > 0 THEN 'basic' ELSE 'free' END AS plan, substr(md5('ref|' || user_id), 1, 8) AS code FROM u")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the scalar functions of the database, as SQL functions that Catalyst inlines."""
    for text in SCALARS.values():
        spark.sql(text)
    role = F.when(F.col("user_id") % 9 == 0, "admin").when(F.col("user_id") % 9 == 1, "service").when(F.col("user_id") % 9 == 2, "user")
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), 4).alias("spent")).withColumn("role", role)
    return u.selectExpr("user_id", "is_admin(role) AS is_admin", "service_or_admin(role) AS trusted", "plan_of(spent) AS plan", "referral_code(user_id) AS code")


def inactive(events: DataFrame, days: int) -> DataFrame:
    """users whose last event is ``days`` or more before the end of the log."""
    end = events.agg(F.max("ts")).first()[0]
    return events.groupBy("user_id").agg(F.max("ts").alias("last_ts")).where(F.col("last_ts") <= F.lit(end) - F.expr(f"INTERVAL {int(days)} DAY"))


def leads(events: DataFrame, most: int) -> DataFrame:
    """the ``most`` users with the most events that have bought nothing."""
    u = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("event_type") == "purchase").alias("bought"))
    return u.where("NOT bought").orderBy(F.desc("n"), "user_id").limit(most).select("user_id", "n")


@query("table_functions", "WITH l AS (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id), n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING NOT bool_or(event_type = 'purchase') ORDER BY n DESC, user_id LIMIT 5) SELECT 'inactive' AS name, user_id, NULL::BIGINT AS n FROM l WHERE last_ts <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY UNION ALL SELECT 'lead', user_id, n FROM n")
def table_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table functions with parameters, as functions that return DataFrames."""
    e = table(spark, sf_dir, "events")
    return inactive(e, 2).select(F.lit("inactive").alias("name"), "user_id", F.lit(None).cast("long").alias("n")).unionByName(leads(e, 5).select(F.lit("lead").alias("name"), "user_id", "n"))


# ---- rules of further kinds of item

_SPOKEN = {"id": "conv_id * 100 + turn", "main": "conv_id % 5", "kind": "CASE WHEN conv_id % 7 = 0 THEN 'otra' WHEN turn % 2 = 0 THEN 'conductual' ELSE 'situacional' END", "level": "conv_id % 4", "situation": "substr(text, 1, 50 + turn * 9)", "ask": "CASE WHEN conv_id % 6 = 0 THEN 'Creus que és correcte fer-ho així?' WHEN conv_id % 11 = 0 THEN 'Com ho faries' ELSE 'Com ho faries, i per què, si ' || substr(text, 1, 20) || '?' END", "n_signs": "turn % 7", "n_errors": "2 + conv_id % 3", "again": "CASE WHEN conv_id % 8 = 0 THEN 'I ara?' ELSE 'Què faries després de tot?' END"}
CLOSED = "estàs|estaries|creus que|és correcte|t'agradaria|vols|faries bé"


@query("scenario_validation", f"""WITH s AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _SPOKEN.items())} FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations))
SELECT id, unnest({_LIST(("kind NOT IN ('conductual', 'situacional')", 'kind'), ('level NOT IN (1, 2, 3)', 'difficulty'), ('length(situation) < 60', 'short situation'), ("length(trim(ask)) NOT BETWEEN 20 AND 220 OR NOT ends_with(trim(ask), '?')", 'open question'), ("regexp_matches(lower(ask), '^¿?(" + CLOSED.replace("'", "''") + ")')", 'closed question'), ('n_signs NOT BETWEEN 3 AND 5', 'signs'), ('n_errors NOT BETWEEN 2 AND 3', 'frequent errors'), ("length(trim(again)) < 15 OR NOT ends_with(trim(again), '?')", 'second question'))}) AS finding FROM s""")
def scenario_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of interview scenarios."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    s = c.selectExpr(*[f"{e} AS {n}" for n, e in {k: v.replace("''", "\\'") for k, v in _SPOKEN.items()}.items()])
    ask, again = F.trim("ask"), F.trim("again")
    found = _known((~F.col("kind").isin("conductual", "situacional"), "kind"), (~F.col("level").isin(1, 2, 3), "difficulty"), (F.char_length("situation") < 60, "short situation"), (~F.char_length(ask).between(20, 220) | ~ask.endswith("?"), "open question"), (F.lower(ask).rlike(f"^¿?({CLOSED})"), "closed question"),
                   (~F.col("n_signs").between(3, 5), "signs"), (~F.col("n_errors").between(2, 3), "frequent errors"), ((F.char_length(again) < 15) | ~again.endswith("?"), "second question"))
    return s.select("id", F.explode(found).alias("finding"))


@query("verbal_validation", f"""WITH {_MADE_SQL}, v AS (SELECT id, 'v-' || (id % 1000) || CASE WHEN id % 21 = 0 THEN '_' ELSE '' END AS name, CASE id % 4 WHEN 0 THEN 'comprension_lectora' WHEN 1 THEN 'sinonimos' WHEN 2 THEN 'antonimos' ELSE 'otro' END AS form, stem, options, answer, explanation, substr(source, 1, 60 + 10 * (id % 20)) AS reading, CASE WHEN id % 6 = 0 THEN 'APROBADO_HUMANO' ELSE 'BORRADOR' END AS state, CASE WHEN id % 12 <> 0 THEN 'Ana' END AS approved_by FROM m)
SELECT id, unnest({_LIST(("NOT regexp_full_match(name, '[a-z0-9-]{3,40}')", 'id'), ("form NOT IN ('comprension_lectora', 'sinonimos', 'antonimos', 'analogias')", 'form'), ('length(stem) < 10', 'short stem'), ("form = 'comprension_lectora' AND length(coalesce(reading, '')) < 120", 'short reading'), ("len(options) <> 4 OR len(list_distinct(list_transform(options, lambda o: lower(trim(o))))) <> 4 OR len(list_filter(options, lambda o: trim(o) = '')) > 0", 'options'), ('answer NOT BETWEEN 0 AND 3', 'answer'), ('length(explanation) < 30', 'short explanation'), ("state = 'APROBADO_HUMANO' AND approved_by IS NULL", 'approved by nobody'))}) AS finding FROM v""")
def verbal_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of semantic and aptitude items, which a person approves."""
    i = F.col("id")
    v = made_items(spark, sf_dir).select("id", F.concat(F.lit("v-"), i % 1000, F.when(i % 21 == 0, "_").otherwise("")).alias("name"), F.when(i % 4 == 0, "comprension_lectora").when(i % 4 == 1, "sinonimos").when(i % 4 == 2, "antonimos").otherwise("otro").alias("form"),
                                         "stem", "options", "answer", "explanation", F.substring("source", F.lit(1), 60 + 10 * (i % 20).cast("int")).alias("reading"), (i % 6 == 0).alias("approved"), F.when(i % 12 != 0, "Ana").alias("approved_by"))
    plain = F.transform("options", lambda o: F.lower(F.trim(o)))
    found = _known((~F.col("name").rlike("^[a-z0-9-]{3,40}$"), "id"), (~F.col("form").isin("comprension_lectora", "sinonimos", "antonimos", "analogias"), "form"), (F.char_length("stem") < 10, "short stem"), ((F.col("form") == "comprension_lectora") & (F.char_length(F.coalesce("reading", F.lit(""))) < 120), "short reading"),
                   ((F.size("options") != 4) | (F.size(F.array_distinct(plain)) != 4) | F.exists(plain, lambda o: o == ""), "options"), (~F.col("answer").between(0, 3), "answer"), (F.char_length("explanation") < 30, "short explanation"), (F.col("approved") & F.col("approved_by").isNull(), "approved by nobody"))
    return v.select("id", F.explode(found).alias("finding"))


@query("generator_distinctness", "WITH x AS (SELECT l_linenumber AS kind, l_returnflag AS form, md5(l_partkey % 97 || '|' || l_quantity::INTEGER) AS exercise, l_quantity > 45 AS wrong FROM lineitem), c AS (SELECT kind, form, count(*) AS n, count(DISTINCT exercise) AS distinct_n, count(*) FILTER (WHERE wrong) AS errors FROM x GROUP BY ALL) SELECT kind, min(distinct_n) AS least_distinct, sum(errors)::BIGINT AS errors, count(*) AS n_forms, CASE WHEN count(*) = 1 THEN 'one form only' ELSE '' END AS gap FROM c GROUP BY kind")
def generator_distinctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different exercises a generator's sample has in each combination, the fewest by kind, and its errors."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("kind"), F.col("l_returnflag").alias("form"), F.md5(F.concat_ws("|", F.col("l_partkey") % 97, F.col("l_quantity").cast("int"))).alias("exercise"), (F.col("l_quantity") > 45).alias("wrong"))
    c = x.groupBy("kind", "form").agg(F.countDistinct("exercise").alias("distinct_n"), F.count_if("wrong").alias("errors"))
    return c.groupBy("kind").agg(F.min("distinct_n").alias("least_distinct"), F.sum("errors").alias("errors"), F.count(F.lit(1)).alias("n_forms"), F.when(F.count(F.lit(1)) == 1, "one form only").otherwise("").alias("gap"))


@query("json_as_text", "SELECT o_orderkey, to_json({'order': o_orderkey, 'status': o_orderstatus, 'lines': [o_custkey, o_custkey % 7]})::VARCHAR AS text FROM orders")
def json_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record as JSON text."""
    lines = F.array(F.col("o_custkey"), F.col("o_custkey") % 7)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status"), lines.alias("lines"))).alias("text"))


@query("exam_import", f"""WITH {_MADE_SQL}, e AS (SELECT id, CASE WHEN quote IS NULL OR source IS NULL THEN 'OFFICIAL_PENDING_REVIEW' WHEN NOT contains(source, quote) THEN 'QUOTE_NOT_FOUND' WHEN NOT in_force THEN 'OUTDATED' ELSE 'OFFICIAL_VERIFIED' END AS status, options[answer + 1] IS NOT NULL AS keyed FROM m) SELECT status, keyed, count(*) AS n, min(id) AS first_id FROM e GROUP BY ALL""")
def exam_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of official exams by what their quote says against the source, with or without a key."""
    m = made_items(spark, sf_dir)
    status = F.when(F.col("quote").isNull() | F.col("source").isNull(), "OFFICIAL_PENDING_REVIEW").when(~F.contains("source", "quote"), "QUOTE_NOT_FOUND").when(~F.col("in_force"), "OUTDATED").otherwise("OFFICIAL_VERIFIED")
    keyed = F.get("options", F.col("answer").cast("int")).isNotNull()
    return m.groupBy(status.alias("status"), keyed.alias("keyed")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
