"""Product analytics: ranking, funnels, retention, attribution, revenue, leads, entitlements, referrals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import AS_OF_SQL, as_of, cents, json_int, ratio
from ..registry import query, table

#: Points of an event type for the score of a lead.
LEAD_WEIGHTS = {"view": 1, "click": 5, "signup": 20, "purchase": 30, "error": 3}
#: Steps of the funnel, in order, by the event type that stands for each.
STEPS = ("view", "signup", "click", "error", "purchase")


def top_ranked(scores: DataFrame, order: list[Column], limit: int = 100) -> DataFrame:
    """Number rows in a total order and keep the first; sorts only the kept rows in one place."""
    best = scores.orderBy(*order).limit(limit)
    return best.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))


@query("ranking", """
SELECT c_name AS alias, score, n_orders, row_number() OVER (ORDER BY score DESC, n_orders DESC, last_order, o_custkey) AS position, c_mktsegment = 'BUILDING' AS is_own_group
FROM (SELECT o_custkey, sum(floor(o_totalprice * 100 + 0.5)::BIGINT)::BIGINT AS score, count(*) AS n_orders, max(o_orderdate) AS last_order FROM orders GROUP BY o_custkey) s
JOIN customer ON c_custkey = o_custkey ORDER BY position LIMIT 100
""")
def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregated scores, a total order, the first hundred."""
    scores = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(cents(F.col("o_totalprice"))).alias("score"), F.count(F.lit(1)).alias("n_orders"), F.max("o_orderdate").alias("last_order"))
    named = scores.join(table(spark, sf_dir, "customer"), scores.o_custkey == F.col("c_custkey"))
    best = top_ranked(named, [F.desc("score"), F.desc("n_orders"), F.asc("last_order"), F.asc("o_custkey")])
    return best.select(F.col("c_name").alias("alias"), "score", "n_orders", "position", (F.col("c_mktsegment") == "BUILDING").alias("is_own_group"))


@query("funnel", """
SELECT count(DISTINCT user_id) FILTER (WHERE event_type = 'view') AS visitors, count(DISTINCT user_id) FILTER (WHERE event_type = 'signup') AS registered,
       count(DISTINCT user_id) FILTER (WHERE event_type = 'click') AS active, count(DISTINCT user_id) FILTER (WHERE event_type = 'error') AS paywalled,
       count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS subscribed, count(*) FILTER (WHERE event_type = 'click') AS completed,
       count(DISTINCT coalesce(user_id::VARCHAR, props)) AS identities, count(*) AS n_events FROM events
""")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional distinct counts in one pass."""
    e = table(spark, sf_dir, "events")
    users = lambda kind: F.countDistinct(F.when(F.col("event_type") == kind, F.col("user_id")))
    return e.agg(
        users("view").alias("visitors"), users("signup").alias("registered"), users("click").alias("active"), users("error").alias("paywalled"), users("purchase").alias("subscribed"),
        F.count_if(F.col("event_type") == "click").alias("completed"), F.countDistinct(F.coalesce(F.col("user_id").cast("string"), "props")).alias("identities"), F.count(F.lit(1)).alias("n_events"),
    )


@query("weakest_step", """
WITH c AS (SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type),
s AS (SELECT t.step, t.name, coalesce(c.n, 0) AS n FROM (VALUES (0, 'view'), (1, 'signup'), (2, 'click'), (3, 'error'), (4, 'purchase')) t(step, name) LEFT JOIN c ON c.event_type = t.name),
p AS (SELECT name, step, n, lag(n) OVER (ORDER BY step) AS base FROM s)
SELECT name AS step_name, n AS n_users, base AS n_before, round(n / base, 4) AS step_ratio FROM p WHERE base > 0 ORDER BY n / base, step LIMIT 1
""")
def weakest_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel step with the smallest ratio to the one before; steps without a base are skipped."""
    counted = table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n"))
    steps = spark.createDataFrame(list(enumerate(STEPS)), "step int, name string")
    n = steps.join(counted, steps.name == counted.event_type, "left").select("step", "name", F.coalesce("n", F.lit(0)).alias("n"))
    based = n.withColumn("base", F.lag("n").over(Window.orderBy("step"))).where("base > 0")  # five rows
    worst = based.orderBy(F.col("n") / F.col("base"), "step").limit(1)
    return worst.select(F.col("name").alias("step_name"), F.col("n").alias("n_users"), F.col("base").alias("n_before"), ratio(F.col("n"), F.col("base")).alias("step_ratio"))


@query("retention_weekly", f"""
WITH a AS (SELECT {AS_OF_SQL} AS d), c AS (SELECT DISTINCT user_id FROM events, a WHERE ts >= d - INTERVAL 14 DAY AND ts < d - INTERVAL 7 DAY),
r AS (SELECT DISTINCT user_id FROM events, a WHERE ts >= d - INTERVAL 7 DAY)
SELECT count(*) AS cohort, count(r.user_id) AS returned, round(CASE WHEN count(*) > 0 THEN count(r.user_id) / count(*) END, 4) AS retention FROM c LEFT JOIN r USING (user_id)
""")
def retention_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: users of the week before last who came back in the last one."""
    e = table(spark, sf_dir, "events")
    now = as_of(e)
    back, ago = now - F.expr("INTERVAL 7 DAY"), now - F.expr("INTERVAL 14 DAY")
    seen = e.where(F.col("ts") >= ago).groupBy("user_id").agg(F.bool_or(F.col("ts") < back).alias("cohort"), F.bool_or(F.col("ts") >= back).alias("later"))
    n, r = F.count_if("cohort"), F.count_if(F.col("cohort") & F.col("later"))
    return seen.agg(n.alias("cohort"), r.alias("returned"), ratio(r, n).alias("retention"))


K_SQL = "CAST(props->>'$.k' AS BIGINT)"


@query("channel_split", f"""
WITH f AS (SELECT user_id, arg_min(coalesce('c' || ({K_SQL} % 5), 'direct'), (ts, event_id)) AS channel, bool_or(event_type = 'purchase') AS bought FROM events GROUP BY user_id)
SELECT channel, count(*) AS n_users, count(*) FILTER (WHERE bought) AS n_bought FROM f GROUP BY channel
""")
def channel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by the channel of their first event."""
    channel = F.coalesce(F.concat(F.lit("c"), json_int(F.col("props"), "$.k") % 5), F.lit("direct"))
    first = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by(channel, F.struct("ts", "event_id")).alias("channel"), F.bool_or(F.col("event_type") == "purchase").alias("bought"))
    return first.groupBy("channel").agg(F.count(F.lit(1)).alias("n_users"), F.count_if("bought").alias("n_bought"))


@query("campaign_top", f"""
SELECT {K_SQL} AS campaign, count(*) FILTER (WHERE event_type = 'view') AS visits, count(*) FILTER (WHERE event_type = 'signup') AS registrations, count(*) FILTER (WHERE event_type = 'purchase') AS purchases
FROM events GROUP BY 1 ORDER BY registrations DESC, visits DESC, campaign LIMIT 20
""")
def campaign_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty campaigns with most registrations, then visits."""
    n = lambda kind, name: F.count_if(F.col("event_type") == kind).alias(name)
    by = table(spark, sf_dir, "events").groupBy(json_int(F.col("props"), "$.k").alias("campaign"))
    return by.agg(n("view", "visits"), n("signup", "registrations"), n("purchase", "purchases")).orderBy(F.desc("registrations"), F.desc("visits"), "campaign").limit(20)


@query("top_entities", f"""
SELECT {K_SQL} AS entity, count(DISTINCT user_id) AS n_visitors FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY n_visitors DESC, entity LIMIT 10
""")
def top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten entities with most distinct visitors."""
    views = table(spark, sf_dir, "events").where("event_type = 'view'")
    return views.groupBy(json_int(F.col("props"), "$.k").alias("entity")).agg(F.countDistinct("user_id").alias("n_visitors")).orderBy(F.desc("n_visitors"), "entity").limit(10)


@query("zero_result_search", f"""
SELECT 'q' || ({K_SQL} % 17) AS term, count(*) AS n FROM events WHERE event_type = 'click' AND {K_SQL} % 10 = 0 GROUP BY 1 ORDER BY n DESC, term LIMIT 10
""")
def zero_result_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent searches without a result (here clicks whose k ends in 0)."""
    k = json_int(F.col("props"), "$.k")
    none = table(spark, sf_dir, "events").where(F.col("event_type") == "click").where(k % 10 == 0)
    return none.groupBy(F.concat(F.lit("q"), k % 17).alias("term")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(10)


def variant(experiment: Column | str, key: Column, weights: tuple[int, ...]) -> Column:
    """Weighted assignment by a hash of ``experiment:key``, modulo the sum of weights, by cumulative weight.

    The hash starts at 0 and takes 31 times itself and the next code unit, modulo 2 ** 32 (fixed values).
    """
    whole = F.concat(F.lit(experiment) if isinstance(experiment, str) else experiment, F.lit(":"), key)
    h = F.aggregate(F.filter(F.split(whole, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda acc, c: (acc * 31 + F.ascii(c)) % F.lit(4294967296))
    at, out, total = h % sum(weights), F.lit(len(weights) - 1), sum(weights)
    for i in range(len(weights) - 1, -1, -1):
        total -= weights[i]
        out = out if i == len(weights) - 1 else F.when(at < total + weights[i], F.lit(i)).otherwise(out)
    return out


_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split('e1:u' || user_id, ''), lambda c: ascii(c)::BIGINT)), lambda acc, c: (acc * 31 + c) % 4294967296)"


@query("experiment_conversion", f"""
WITH u AS (SELECT user_id, bool_or(event_type = 'view') AS exposed, bool_or(event_type = 'signup') AS converted, min(ts) FILTER (WHERE event_type = 'view') AS t0, max(ts) FILTER (WHERE event_type = 'signup') AS t1 FROM events GROUP BY user_id),
v AS (SELECT *, CASE WHEN {_HASH} % 100 < 50 THEN 0 WHEN {_HASH} % 100 < 80 THEN 1 ELSE 2 END AS variant FROM u WHERE exposed)
SELECT variant::INTEGER AS variant, count(*) AS exposed, count(*) FILTER (WHERE converted) AS converted, count(*) FILTER (WHERE t1 >= t0) AS converted_after FROM v GROUP BY variant
""")
def experiment_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposures and conversions by variant; ``converted_after`` asks that a conversion follows the exposure."""
    when = lambda kind: F.when(F.col("event_type") == kind, F.col("ts"))
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(when("view")).alias("t0"), F.max(when("signup")).alias("t1")).where("t0 IS NOT NULL")
    named = users.withColumn("variant", variant("e1", F.concat(F.lit("u"), "user_id"), (50, 30, 20)))
    return named.groupBy("variant").agg(F.count(F.lit(1)).alias("exposed"), F.count("t1").alias("converted"), F.count_if(F.col("t1") >= F.col("t0")).alias("converted_after"))


_WEIGHTS = ", ".join(f"('{k}', {v})" for k, v in LEAD_WEIGHTS.items())


@query("lead_scoring", f"""
WITH t AS (SELECT user_id, event_type, count(*) AS n, count(DISTINCT ts::DATE) AS days FROM events GROUP BY ALL), w(kind, weight) AS (VALUES {_WEIGHTS})
SELECT user_id, sum(coalesce(weight, 0) * least(n, 5) + CASE WHEN days >= 3 THEN 15 ELSE 0 END)::BIGINT AS score, bool_or(event_type = 'signup') AS registered, bool_or(event_type = 'purchase') AS paying
FROM t LEFT JOIN w ON kind = event_type GROUP BY user_id
""")
def lead_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight times at most five events of a type, and 15 for a type seen on three days."""
    weights = spark.createDataFrame(list(LEAD_WEIGHTS.items()), "event_type string, weight int")
    typed = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.to_date("ts")).alias("days"))
    points = F.coalesce("weight", F.lit(0)) * F.least("n", F.lit(5)) + F.when(F.col("days") >= 3, 15).otherwise(0)
    scored = typed.join(F.broadcast(weights), "event_type", "left")  # one row per event type
    return scored.groupBy("user_id").agg(F.sum(points).alias("score"), F.bool_or(F.col("event_type") == "signup").alias("registered"), F.bool_or(F.col("event_type") == "purchase").alias("paying"))


@query("mrr_ltv", """
WITH s AS (SELECT o_orderstatus AS st, floor(o_totalprice * 100 + 0.5)::BIGINT AS c FROM orders)
SELECT count(*) FILTER (WHERE st IN ('O', 'P')) AS active, (sum(c) FILTER (WHERE st = 'O'))::BIGINT AS mrr_cents, count(*) FILTER (WHERE st = 'F') AS churned,
       round(CASE WHEN count(*) FILTER (WHERE st = 'F') >= 20 THEN avg(c) / greatest(0.01, (count(*) FILTER (WHERE st = 'F')) / count(*)) END, 2) AS ltv_cents FROM s
""")
def mrr_ltv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, A4: open orders stand for paying subscriptions, P for trials, F for churned ones; the value over a lifetime needs 20 churned."""
    s = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("st"), cents(F.col("o_totalprice")).alias("c"))
    churned = F.count_if(F.col("st") == "F")
    ltv = F.when(churned >= 20, F.avg("c") / F.greatest(F.lit(0.01), churned / F.count(F.lit(1))))
    return s.agg(F.count_if(F.col("st").isin("O", "P")).alias("active"), F.sum(F.when(F.col("st") == "O", F.col("c"))).alias("mrr_cents"), churned.alias("churned"), F.round(ltv, 2).alias("ltv_cents"))


@query("inactive_users", """
WITH o AS (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY o_custkey), e AS (SELECT user_id, max(ts) AS last_event FROM events GROUP BY user_id),
l AS (SELECT c_custkey, greatest(last_order, last_event) AS last_seen FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN e ON user_id = c_custkey),
d AS (SELECT max(last_seen)::DATE AS today FROM l)
SELECT c_custkey, last_seen, date_diff('day', last_seen::DATE, today)::INTEGER AS days_idle, 'USER_INACTIVE:' || c_custkey || ':' || last_seen::DATE AS idempotency_key FROM l, d
WHERE date_diff('day', last_seen::DATE, today) IN (3, 5, 7, 14, 30)
""")
def inactive_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers idle for exactly one of the reminder periods; each side is aggregated before the joins."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"))
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_event"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    seen = c.join(o, c.c_custkey == o.o_custkey, "left").join(e, c.c_custkey == e.user_id, "left").select("c_custkey", F.greatest("last_order", "last_event").alias("last_seen"))
    today = F.lit(seen.agg(F.to_date(F.max("last_seen")).alias("d")).first().d)
    idle = seen.withColumn("days_idle", F.datediff(today, F.to_date("last_seen"))).where(F.col("days_idle").isin(3, 5, 7, 14, 30))
    return idle.select("c_custkey", "last_seen", "days_idle", F.concat(F.lit("USER_INACTIVE:"), "c_custkey", F.lit(":"), F.to_date("last_seen").cast("string")).alias("idempotency_key"))


@query("entitlement_latest", """
WITH d AS (SELECT max(o_orderdate) AS today FROM orders), l AS (SELECT o_custkey, arg_max(struct_pack(s := o_orderstatus, d := o_orderdate, p := o_orderpriority), (o_orderdate, o_orderkey)) AS x FROM orders GROUP BY o_custkey)
SELECT o_custkey, x.s AS status, x.d AS updated, CASE WHEN x.s IN ('O', 'P') THEN 'premium' WHEN x.d + INTERVAL 90 DAY > today THEN 'premium' ELSE 'free' END AS plan FROM l, d
""")
def entitlement_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order decides; a cancelled one (F) still counts until it ends, 90 days on."""
    o = table(spark, sf_dir, "orders")
    today = F.lit(o.agg(F.max("o_orderdate").alias("d")).first().d).cast("timestamp_ntz")
    latest = o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderstatus", "o_orderdate"), F.struct("o_orderdate", "o_orderkey")).alias("x"))
    status, when = F.col("x.o_orderstatus"), F.col("x.o_orderdate")
    plan = F.when(status.isin("O", "P") | (when + F.expr("INTERVAL 90 DAY") > today), "premium").otherwise("free")
    return latest.select("o_custkey", status.alias("status"), when.alias("updated"), plan.alias("plan"))


@query("scorecard", """
WITH s AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n_orders, sum(floor(l_extendedprice * 100 + 0.5)::BIGINT)::BIGINT AS amount, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned FROM lineitem GROUP BY l_suppkey)
SELECT s_suppkey, s_name, coalesce(n_orders, 0) AS n_orders, coalesce(amount, 0) AS amount_cents, coalesce(n_returned, 0) AS n_returned, floor(coalesce(amount, 0) * 20 / 100.0 + 0.5)::BIGINT AS commission_cents
FROM supplier LEFT JOIN s ON l_suppkey = s_suppkey
""")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the facts, then a left join, instead of scalar subqueries; commission is 20 per cent."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("n_orders"), F.sum(cents(F.col("l_extendedprice"))).alias("amount"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))
    p = table(spark, sf_dir, "supplier")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return p.join(s, p.s_suppkey == s.l_suppkey, "left").select("s_suppkey", "s_name", zero("n_orders").alias("n_orders"), zero("amount").alias("amount_cents"), zero("n_returned").alias("n_returned"), F.floor(zero("amount") * 20 / 100.0 + 0.5).cast("long").alias("commission_cents"))


@query("referral_decision", """
WITH r AS (SELECT event_id, user_id, ts, (user_id * 7 + event_id) % 160 AS referrer FROM events WHERE event_type = 'signup'), u AS (SELECT user_id AS uid, min(ts) AS created, any_value(user_id % 13) AS device FROM events GROUP BY user_id),
x AS (SELECT r.*, b.uid IS NOT NULL AS known, a.created, a.device AS d1, b.device AS d2, count(*) OVER (PARTITION BY referrer ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS in_day FROM r LEFT JOIN u a ON a.uid = r.user_id LEFT JOIN u b ON b.uid = r.referrer)
SELECT event_id, CASE WHEN NOT known THEN 'unknown' WHEN referrer = user_id THEN 'self' WHEN ts > created + INTERVAL 48 HOUR THEN 'old_account' WHEN d1 = d2 THEN 'same_device' WHEN in_day >= 20 THEN 'review' ELSE 'registered' END AS decision FROM x
""")
def referral_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered checks of a referral: unknown or own referrer, account over 48 hours old, same device, 20 in a day."""
    e = table(spark, sf_dir, "events")
    u = e.groupBy("user_id").agg(F.min("ts").alias("created")).withColumn("device", F.col("user_id") % 13)
    r = e.where("event_type = 'signup'").select("event_id", "user_id", "ts", ((F.col("user_id") * 7 + F.col("event_id")) % 160).alias("referrer"))
    counted = r.withColumn("in_day", F.expr("count(*) OVER (PARTITION BY referrer ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)"))
    x = counted.join(u, "user_id", "left").join(u.select(F.col("user_id").alias("referrer"), F.col("device").alias("d2")), "referrer", "left")
    decision = F.when(F.col("d2").isNull(), "unknown").when(F.col("referrer") == F.col("user_id"), "self").when(F.col("ts") > F.col("created") + F.expr("INTERVAL 48 HOUR"), "old_account").when(F.col("device") == F.col("d2"), "same_device").when(F.col("in_day") >= 20, "review").otherwise("registered")
    return x.select("event_id", decision.alias("decision"))
