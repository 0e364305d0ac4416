"""The event log, rules and jobs: guards, limits, attribution, importance, planning, back-off, retention, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import AS_OF_SQL, as_of, json_int
from ..registry import query, table

K_SQL = "CAST(props->>'$.k' AS BIGINT)"


def trailing(n: str, key: str, by: str = "ts") -> Column:
    """Rows of a key in the time ``n`` up to and including the row."""
    return F.expr(f"count(*) OVER (PARTITION BY {key} ORDER BY {by} RANGE BETWEEN INTERVAL {n} PRECEDING AND CURRENT ROW)")


def guard(types: tuple[str, ...], payload_bytes: int = 2048) -> Column:
    """Allowed types, the form of the device id ``anon``, a limit on the payload's bytes."""
    return F.when(~F.col("event_type").isin(*types), "type").when(~F.col("anon").rlike("^[a-z0-9]{16,40}$"), "anon_id").when(F.octet_length("props") > payload_bytes, "payload").otherwise("ok")


@query("input_guards", """
SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click', 'signup', 'purchase') THEN 'type' WHEN NOT regexp_matches(md5(user_id::VARCHAR), '^[a-z0-9]{16,40}$') THEN 'anon_id' WHEN strlen(props) > 9 THEN 'payload' ELSE 'ok' END AS verdict FROM events
""")
def input_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an event is refused for; the example's payloads are small, so is its limit."""
    e = table(spark, sf_dir, "events").withColumn("anon", F.md5(F.col("user_id").cast("string")))
    return e.select("event_id", guard(("view", "click", "signup", "purchase"), payload_bytes=9).alias("verdict"))


def rate_limited(events: DataFrame, limit: int = 300, key: str = "user_id") -> DataFrame:
    """Events with how many a key has in the hour up to each, and whether that is over the limit."""
    return events.withColumn("n_in_hour", trailing("1 HOUR", key)).withColumn("refused", F.col("n_in_hour") > limit)


@query("rate_limit_flags", """
SELECT event_id, user_id, n_in_hour, n_in_hour > 3 AS refused FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n_in_hour FROM events)
""")
def rate_limit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a device in the trailing hour, with a limit that the example's few events reach."""
    return rate_limited(table(spark, sf_dir, "events"), limit=3).select("event_id", "user_id", "n_in_hour", "refused")


@query("daily_quota", """
SELECT event_id, user_id, n AS use_of_day, n <= 5 AS allowed FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click')
""")
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's uses within a day are numbered; those past the quota are refused."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").where("event_type = 'click'").withColumn("use_of_day", F.row_number().over(w).cast("long"))
    return e.select("event_id", "user_id", "use_of_day", (F.col("use_of_day") <= 5).alias("allowed"))


@query("first_last_touch", f"""
WITH v AS (SELECT user_id, ts, event_id, CASE WHEN {K_SQL} % 3 = 0 THEN 'c' || {K_SQL} END AS campaign FROM events WHERE event_type = 'view')
SELECT user_id, event_id, coalesce(campaign, 'direct') AS touch, coalesce(first_value(campaign IGNORE NULLS) OVER w, 'direct') AS first_touch, coalesce(last_value(campaign IGNORE NULLS) OVER w, 'direct') AS last_touch
FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def first_last_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first attributed visit stays the first touch; only attributed visits replace the last one."""
    k = json_int(F.col("props"), "$.k")
    v = table(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", "ts", "event_id", F.when(k % 3 == 0, F.concat(F.lit("c"), k)).alias("campaign"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    direct = lambda c: F.coalesce(c, F.lit("direct"))
    return v.select("user_id", "event_id", direct(F.col("campaign")).alias("touch"), direct(F.first("campaign", True).over(w)).alias("first_touch"), direct(F.last("campaign", True).over(w)).alias("last_touch"))


def idempotency_key(kind: Column, entity: Column, payload: Column) -> Column:
    """Type, entity and sixteen digits of the payload's SHA-256."""
    return F.concat_ws(":", kind, entity.cast("string"), F.substring(F.sha2(payload, 256), 1, 16))


@query("idempotent_append", """
WITH k AS (SELECT *, concat_ws(':', event_type, user_id::VARCHAR, substr(sha256(props), 1, 16)) AS idempotency_key FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY ts, event_id) AS n FROM k)
SELECT event_id, idempotency_key FROM r WHERE n = 1
""")
def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of events with one key the first stays."""
    e = table(spark, sf_dir, "events").withColumn("idempotency_key", idempotency_key(F.col("event_type"), F.col("user_id"), F.col("props")))
    return e.groupBy("idempotency_key").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")).select("event_id", "idempotency_key")


def importance(kind: Column, size: Column) -> Column:
    """An ordered classifier into four levels."""
    return F.when((kind == "purchase") & (size >= 80), "CRITICAL").when(kind.isin("purchase", "signup") & (size >= 30), "HIGH").when((kind == "error") | (size >= 70), "MEDIUM").otherwise("LOW")


_IMPORTANCE = f"CASE WHEN event_type = 'purchase' AND {K_SQL} >= 80 THEN 'CRITICAL' WHEN event_type IN ('purchase', 'signup') AND {K_SQL} >= 30 THEN 'HIGH' WHEN event_type = 'error' OR {K_SQL} >= 70 THEN 'MEDIUM' ELSE 'LOW' END"
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


@query("importance", f"SELECT event_id, {_IMPORTANCE} AS importance FROM events")
def importance_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7."""
    return table(spark, sf_dir, "events").select("event_id", importance(F.col("event_type"), json_int(F.col("props"), "$.k")).alias("importance"))


#: Rules as data: name, event type, least level, modulo of k that must be 0, actions, priority.
RULES = [("alert", "purchase", 2, 1, ["mail", "post"], 1), ("follow", "signup", 1, 2, ["mail"], 2), ("inspect", "error", 0, 5, ["review"], 4), ("sample", "view", 0, 10, ["log"], 6)]


@query("rule_jobs", f"""
WITH e AS (SELECT event_id, event_type, ts, {K_SQL} AS k, CASE {_IMPORTANCE} WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END AS level FROM events),
r(rule, kind, least, every, actions, priority) AS (VALUES ('alert', 'purchase', 2, 1, ['mail', 'post'], 1), ('follow', 'signup', 1, 2, ['mail'], 2), ('inspect', 'error', 0, 5, ['review'], 4), ('sample', 'view', 0, 10, ['log'], 6))
SELECT event_id, rule, unnest(actions) AS action, priority FROM e JOIN r ON kind = event_type AND level >= least AND k % every = 0
""")
def rule_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rules table joined to events by a condition, its actions exploded into jobs."""
    rules = spark.createDataFrame(RULES, "rule string, kind string, least int, every int, actions array<string>, priority int")
    k = json_int(F.col("props"), "$.k")
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), importance(F.col("event_type"), k)) - 1
    e = table(spark, sf_dir, "events").select("event_id", "event_type", k.alias("k"), rank.alias("level"))
    hit = e.join(F.broadcast(rules), (F.col("kind") == F.col("event_type")) & (F.col("level") >= F.col("least")) & (F.col("k") % F.col("every") == 0))  # a handful of rules
    return hit.select("event_id", "rule", F.explode("actions").alias("action"), "priority")


@query("job_backoff", """
WITH j AS (SELECT user_id, event_type, count(*) AS tries, max(ts) AS last_try FROM events WHERE event_type IN ('error', 'click') GROUP BY ALL)
SELECT user_id, event_type, CASE WHEN event_type = 'click' THEN 'done' WHEN tries >= 4 THEN 'dead' ELSE 'pending' END AS status, least(tries, 4) AS retries, CASE WHEN event_type = 'error' AND tries < 4 THEN last_try + INTERVAL 1 MINUTE * (5 * (1 << (tries - 1))) END AS run_after FROM j
""")
def job_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failed job waits 5 minutes, doubled with each retry, and is dead after four."""
    j = table(spark, sf_dir, "events").where("event_type IN ('error', 'click')").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("tries"), F.max("ts").alias("last_try"))
    failed = F.col("event_type") == "error"
    wait = F.make_dt_interval(F.lit(0), F.lit(0), (5 * F.expr("shiftleft(1, cast(least(tries, 4) as int) - 1)")).cast("int"))
    return j.select("user_id", "event_type", F.when(~failed, "done").when(F.col("tries") >= 4, "dead").otherwise("pending").alias("status"), F.least("tries", F.lit(4)).alias("retries"), F.when(failed & (F.col("tries") < 4), F.col("last_try") + wait).alias("run_after"))


@query("compaction", f"""
WITH r AS (SELECT event_id, event_type = 'error' AS open, row_number() OVER (PARTITION BY event_type = 'error' ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT event_id, open AS unfinished FROM r WHERE open OR n <= 300
""")
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8, K7: all unfinished jobs and the newest 300 finished ones."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("event_type") == "error").alias("unfinished"))
    return compacted(e, keep=300).select("event_id", "unfinished")


def compacted(jobs: DataFrame, keep: int = 3000) -> DataFrame:
    """K8: jobs that are ``unfinished``, and the newest ``keep`` of the others."""
    done = jobs.where(~F.col("unfinished")).orderBy(F.desc("ts"), F.desc("event_id")).limit(keep)
    return jobs.where("unfinished").unionByName(done)


@query("fanout_digest", f"""
WITH f AS (SELECT c_custkey, [c_custkey % 7, c_custkey % 11 + 20] AS follows, CASE c_custkey % 3 WHEN 0 THEN 'now' WHEN 1 THEN 'daily' ELSE 'weekly' END AS frequency FROM customer), x AS (SELECT c_custkey, frequency, unnest(follows) AS k FROM f),
h AS (SELECT c_custkey, frequency, CASE frequency WHEN 'now' THEN ts WHEN 'daily' THEN date_trunc('day', ts) + INTERVAL 1 DAY ELSE date_trunc('week', ts) + INTERVAL 7 DAY END AS send_at FROM x JOIN events ON {K_SQL} = k WHERE event_type IN ('purchase', 'signup'))
SELECT frequency, send_at, count(*) AS n_items, count(DISTINCT c_custkey) AS n_users FROM h GROUP BY ALL
""")
def fanout_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to the users who follow them, grouped into digests sent at once, daily or on Mondays.

    Users of one frequency and one list are counted first, and events of one digest and key; only these counts meet.
    """
    key = F.col("c_custkey")
    frequency = F.when(key % 3 == 0, "now").when(key % 3 == 1, "daily").otherwise("weekly")
    lists = table(spark, sf_dir, "customer").groupBy(frequency.alias("frequency"), F.array(key % 7, key % 11 + 20).alias("follows")).agg(F.count(F.lit(1)).alias("n_users"))
    e = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'signup')").select("ts", json_int(F.col("props"), "$.k").alias("k"))
    trunc = lambda unit, days: F.expr(f"CAST(date_trunc('{unit}', ts) AS timestamp_ntz) + INTERVAL {days} DAY")
    sends = F.array(*[F.struct(F.lit(name).alias("frequency"), at.alias("send_at")) for name, at in (("now", F.col("ts")), ("daily", trunc("day", 1)), ("weekly", trunc("week", 7)))])
    items = e.select("k", F.explode(sends).alias("s")).groupBy("k", "s.frequency", "s.send_at").agg(F.count(F.lit(1)).alias("n"))
    met = items.join(lists.select("frequency", "follows", "n_users", F.explode("follows").alias("k")), ["frequency", "k"])
    by_list = met.groupBy("frequency", "send_at", "follows").agg(F.sum(F.col("n") * F.col("n_users")).alias("n_items"), F.max("n_users").alias("n_users"))
    return by_list.groupBy("frequency", "send_at").agg(F.sum("n_items").alias("n_items"), F.sum("n_users").alias("n_users"))


@query("daily_counts", f"SELECT ts::DATE AS day, event_type, count(*) AS n FROM events WHERE ts >= {AS_OF_SQL} - INTERVAL 120 DAY GROUP BY ALL")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by day, kept for 120 days."""
    e = table(spark, sf_dir, "events")
    return e.where(F.col("ts") >= as_of(e) - F.expr("INTERVAL 120 DAY")).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("calendar_ticks", """
SELECT DISTINCT 'DAY:' || ts::DATE AS tick FROM events UNION SELECT DISTINCT 'WEEK:' || isoyear(ts) || '-' || lpad(weekofyear(ts)::VARCHAR, 2, '0') FROM events
""")
def calendar_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per day and one per ISO week."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("d")).distinct()
    week = F.concat(F.lit("WEEK:"), F.extract(F.lit("YEAROFWEEK"), "d").cast("string"), F.lit("-"), F.lpad(F.weekofyear("d").cast("string"), 2, "0"))
    return e.select(F.explode(F.array(F.concat(F.lit("DAY:"), F.col("d").cast("string")), week)).alias("tick")).distinct()


@query("alias_suffix", """
SELECT c_custkey, CASE WHEN n = 1 THEN a ELSE a || n END AS alias FROM (SELECT c_custkey, lower(c_mktsegment) || '-' || c_nationkey AS a, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS n FROM customer)
""")
def alias_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal aliases get a number in the order of their keys."""
    a = F.concat_ws("-", F.lower("c_mktsegment"), "c_nationkey")
    n = F.row_number().over(Window.partitionBy("c_mktsegment", "c_nationkey").orderBy("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", a.alias("a"), n.alias("n")).select("c_custkey", F.when(F.col("n") == 1, F.col("a")).otherwise(F.concat("a", F.col("n").cast("string"))).alias("alias"))


@query("version_chain", """
WITH h AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus AS content, lag(o_orderstatus) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), v AS (SELECT * FROM h WHERE before IS DISTINCT FROM content)
SELECT o_custkey, o_orderkey, content, row_number() OVER w AS version, lag(o_orderkey) OVER w AS previous_key, lead(o_orderdate) OVER w AS valid_to FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new version begins where the content differs from the snapshot before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_orderstatus").alias("content"))
    v = o.withColumn("before", F.lag("content").over(w)).where(~F.col("before").eqNullSafe(F.col("content")))
    return v.select("o_custkey", "o_orderkey", "content", F.row_number().over(w).cast("long").alias("version"), F.lag("o_orderkey").over(w).alias("previous_key"), F.lead("o_orderdate").over(w).alias("valid_to"))


@query("change_events", """
WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, lag(o_orderstatus) OVER w AS s0, lag(o_orderpriority) OVER w AS p0, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
c AS (SELECT o_custkey, o_orderkey, unnest([{'field': 'status', 'old': s0, 'new': o_orderstatus}, {'field': 'priority', 'old': p0, 'new': o_orderpriority}]) AS x FROM s WHERE n > 1)
SELECT o_custkey, o_orderkey, x.field AS field, x.old AS old_value, x.new AS new_value FROM c WHERE x.old IS DISTINCT FROM x.new
""")
def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field by field differences of consecutive snapshots."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    s = table(spark, sf_dir, "orders").withColumns({"s0": F.lag("o_orderstatus").over(w), "p0": F.lag("o_orderpriority").over(w), "n": F.row_number().over(w)}).where("n > 1")
    field = lambda name, old, new: F.struct(F.lit(name).alias("field"), F.col(old).alias("old_value"), F.col(new).alias("new_value"))
    return s.select("o_custkey", "o_orderkey", F.inline(F.array(field("status", "s0", "o_orderstatus"), field("priority", "p0", "o_orderpriority")))).where("NOT old_value <=> new_value")


@query("latest_upsert", """
SELECT l_partkey, arg_max(struct_pack(q := l_quantity, o := l_orderkey), (l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity)).q AS quantity, count(*) AS n_versions FROM lineitem GROUP BY l_partkey
""")
def latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of a key wins."""
    key = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max_by("l_quantity", key).alias("quantity"), F.count(F.lit(1)).alias("n_versions"))


@query("progress_merge", f"""
WITH a AS (SELECT user_id, {K_SQL} AS item, event_id % 2 AS device, ts, event_id FROM events), p AS (SELECT user_id, item, device, count(*) AS n, max(ts) AS last_ts FROM a GROUP BY ALL)
SELECT user_id, item, max(n) AS n, max(last_ts) AS last_ts, arg_max(device, (last_ts, device)) AS from_device FROM p GROUP BY user_id, item
""")
def progress_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two devices' progress by key: the newest one, with the largest counter."""
    p = table(spark, sf_dir, "events").groupBy("user_id", json_int(F.col("props"), "$.k").alias("item"), (F.col("event_id") % 2).alias("device")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
    return p.groupBy("user_id", "item").agg(F.max("n").alias("n"), F.max("last_ts").alias("m"), F.max_by("device", F.struct("last_ts", "device")).alias("from_device")).withColumnRenamed("m", "last_ts")


@query("schedule_buckets", f"""
SELECT event_id, CASE WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'tomorrow' WHEN d <= 7 THEN 'week' WHEN d <= 31 THEN 'month' ELSE 'later' END AS bucket FROM (SELECT event_id, date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) AS d FROM events)
""")
def schedule_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far off a date is."""
    e = table(spark, sf_dir, "events")
    d = F.datediff(F.to_date("ts"), F.lit(e.agg(F.to_date(F.min("ts")).alias("d")).first().d))
    return e.select("event_id", F.when(d == 0, "today").when(d == 1, "tomorrow").when(d <= 7, "week").when(d <= 31, "month").otherwise("later").alias("bucket"))
