"""Catalogue states: deadlines, profiles, provenance, calendars, lifecycle, reports, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import AS_OF_SQL, as_of, json_int
from ..registry import query, table
from ..tables import number_rows

_TODAY = "(SELECT max(o_orderdate) FROM orders)"


def last_day(orders: DataFrame) -> Column:
    return F.lit(orders.agg(F.max("o_orderdate").alias("d")).first().d).cast("timestamp_ntz")


@query("deadline_states", f"""
SELECT o_orderkey, CASE WHEN date_diff('day', o_orderdate::DATE, {_TODAY}::DATE) > 540 THEN 'historic' WHEN o_orderstatus = 'F' THEN 'closed' WHEN date_diff('day', o_orderdate::DATE, {_TODAY}::DATE) <= 20 THEN 'open' WHEN date_diff('day', o_orderdate::DATE, {_TODAY}::DATE) <= 27 THEN 'probably_closed' ELSE 'closed' END AS state,
       date_diff('day', o_orderdate::DATE, {_TODAY}::DATE)::INTEGER AS age FROM orders
""")
def deadline_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historic after 540 days, open for twenty days, a week of margin, else closed."""
    o = table(spark, sf_dir, "orders")
    age = F.datediff(last_day(o).cast("date"), F.to_date("o_orderdate"))
    state = F.when(age > 540, "historic").when(F.col("o_orderstatus") == "F", "closed").when(age <= 20, "open").when(age <= 27, "probably_closed").otherwise("closed")
    return o.select("o_orderkey", state.alias("state"), age.alias("age"))


@query("content_states", """
WITH h AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'draft' WHEN 'O' THEN 'approved' ELSE 'published' END AS state, row_number() OVER w AS n, lag(o_orderstatus) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, arg_max(state, n) AS current_state, count(*) AS n_steps, count(*) FILTER (WHERE state = 'published' AND before = 'P') AS n_skipped FROM h GROUP BY o_custkey
""")
def content_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only history, its current state and steps that skip approval."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    state = F.when(F.col("o_orderstatus") == "P", "draft").when(F.col("o_orderstatus") == "O", "approved").otherwise("published")
    h = table(spark, sf_dir, "orders").select("o_custkey", state.alias("state"), F.lag("o_orderstatus").over(w).alias("before"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return h.groupBy("o_custkey").agg(F.max_by("state", "at").alias("current_state"), F.count(F.lit(1)).alias("n_steps"), F.count_if((F.col("state") == "published") & (F.col("before") == "P")).alias("n_skipped"))


@query("profile_document", """
WITH i AS (SELECT o_custkey, count(*) AS n, list(o_orderkey ORDER BY o_orderkey) AS ks FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_name, n_name AS territory, coalesce(n, 0) AS n_orders, coalesce(ks[1:3], []::BIGINT[]) AS first_orders, CASE WHEN n IS NULL THEN 'NO_SOURCE' ELSE 'SOURCED' END AS provenance FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN i ON o_custkey = c_custkey
""")
def profile_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested profile per entity, with where its values come from; only the first three children are kept."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    i = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.col("o_orderkey")))).alias("ks"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(i, F.col("o_custkey") == F.col("c_custkey"), "left")
    return c.select("c_custkey", "c_name", F.col("n_name").alias("territory"), F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("ks", F.array().cast("array<bigint>")).alias("first_orders"), F.when(F.col("n").isNull(), "NO_SOURCE").otherwise("SOURCED").alias("provenance"))


@query("administration_level", """
SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 0 THEN 'state' WHEN n_nationkey % 3 = 0 THEN 'region' WHEN n_name LIKE '%1%' THEN 'local' ELSE 'other' END AS level, r_name FROM nation JOIN region ON r_regionkey = n_regionkey
""")
def administration_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered mapping to levels."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    level = F.when(F.col("n_regionkey") == 0, "state").when(F.col("n_nationkey") % 3 == 0, "region").when(F.col("n_name").contains("1"), "local").otherwise("other")
    return n.select("n_nationkey", "n_name", level.alias("level"), "r_name")


@query("follow_list", """
WITH f AS (SELECT user_id, CAST(props->>'$.k' AS BIGINT) AS k, min(ts) AS t, min(event_id) AS e FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, e) AS n FROM f)
SELECT user_id, list(k ORDER BY n) AS follows FROM r WHERE n <= 10 GROUP BY user_id
""")
def follow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct entries in the order of their first appearance, ten at most."""
    f = table(spark, sf_dir, "events").groupBy("user_id", json_int(F.col("props"), "$.k").alias("k")).agg(F.min("ts").alias("t"), F.min("event_id").alias("e"))
    r = f.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "e"))).where("n <= 10")
    return r.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "k"))), lambda x: x["k"]).alias("follows"))


@query("unread_alerts", """
WITH s AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'view') AS seen FROM events GROUP BY user_id)
SELECT s.user_id, count(e.event_id) AS n_unread FROM s LEFT JOIN events e ON e.user_id = s.user_id AND e.event_type IN ('purchase', 'signup') AND (seen IS NULL OR e.ts > seen) GROUP BY s.user_id
""")
def unread_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant events since a user last looked; one pass over windows instead of a join."""
    e = table(spark, sf_dir, "events").withColumn("seen", F.max(F.when(F.col("event_type") == "view", F.col("ts"))).over(Window.partitionBy("user_id")))
    return e.groupBy("user_id").agg(F.count_if(F.col("event_type").isin("purchase", "signup") & (F.col("seen").isNull() | (F.col("ts") > F.col("seen")))).alias("n_unread"))


@query("training_calendar", f"""
WITH d AS (SELECT unnest(generate_series({AS_OF_SQL}::DATE, {AS_OF_SQL}::DATE + 69, INTERVAL 1 DAY))::DATE AS day)
SELECT day, date_diff('day', {AS_OF_SQL}::DATE, day) // 7 AS week, CASE WHEN date_diff('day', {AS_OF_SQL}::DATE, day) < 28 THEN 'base' WHEN date_diff('day', {AS_OF_SQL}::DATE, day) < 56 THEN 'build' ELSE 'peak' END AS phase FROM d WHERE isodow(day) IN (1, 3, 5)
""")
def training_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten weeks of Mondays, Wednesdays and Fridays with their phase."""
    first = as_of(table(spark, sf_dir, "events")).cast("date")
    d = spark.range(1).select(F.explode(F.sequence(first, F.date_add(first, 69))).alias("day")).withColumn("n", F.datediff("day", first))
    phase = F.when(F.col("n") < 28, "base").when(F.col("n") < 56, "build").otherwise("peak")
    return d.where(F.weekday("day").isin(0, 2, 4)).select("day", F.floor(F.col("n") / 7).cast("long").alias("week"), phase.alias("phase"))


@query("publication_calendar", """
WITH q AS (SELECT event_id, event_type AS channel, ts::DATE AS day, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events WHERE event_type IN ('purchase', 'signup')), f AS (SELECT channel, min(day) AS first_day FROM q GROUP BY channel)
SELECT event_id, q.channel, (first_day + (i // 3)::INTEGER)::DATE AS publish_on FROM q JOIN f ON f.channel = q.channel
""")
def publication_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items take the next day with a free place, three per channel and day. Items are numbered by ranges, as channels are few and large."""
    q = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup")).select("event_id", "ts", F.col("event_type").alias("channel"))
    numbered = number_rows(q, ["channel", "ts", "event_id"])
    first = numbered.groupBy("channel").agg(F.min("row_number").alias("first"), F.min("ts").alias("first_ts"))
    place = F.floor((F.col("row_number") - F.col("first")) / 3).cast("int")
    return numbered.join(first, "channel").select("event_id", "channel", F.date_add(F.to_date("first_ts"), place).alias("publish_on"))


@query("pagination", """
SELECT page_id, (row_number() OVER (ORDER BY page_id DESC) - 1) // 20 + 1 AS page_number, ceil(count(*) OVER () / 20.0)::BIGINT AS n_pages FROM pages ORDER BY page_id DESC LIMIT 100
""")
def pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred latest, twenty to a page; only those are numbered."""
    p = table(spark, sf_dir, "pages").select("page_id")
    n = p.count()
    last = p.orderBy(F.desc("page_id")).limit(100).withColumn("r", F.row_number().over(Window.orderBy(F.desc("page_id"))))
    return last.select("page_id", F.floor((F.col("r") - 1) / 20).cast("long").alias("x"), F.lit(-(-n // 20)).cast("long").alias("n_pages")).select("page_id", (F.col("x") + 1).alias("page_number"), "n_pages")


@query("mock_exam", """
WITH b AS (SELECT p_partkey, p_type, p_size, row_number() OVER (PARTITION BY p_type ORDER BY p_size % 7 = 0, md5('e1|' || p_partkey), p_partkey) AS r FROM part), c AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type),
e AS (SELECT p_type, 20 * n / sum(n) OVER () AS exact FROM c), q AS (SELECT p_type, floor(exact)::BIGINT + CASE WHEN row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, p_type) <= 20 - sum(floor(exact)::BIGINT) OVER () THEN 1 ELSE 0 END AS quota FROM e)
SELECT p_partkey, b.p_type, quota FROM b JOIN q ON q.p_type = b.p_type WHERE r <= quota
""")
def mock_exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty items by the types' shares; recently used ones (here sizes divisible by seven) come last."""
    from .coverage import largest_remainder

    p = table(spark, sf_dir, "part")
    quota = largest_remainder(p.groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.lit(0)), "g", "p_type", "n", F.lit(20)).select("p_type", F.col("seats").alias("quota"))
    w = Window.partitionBy("p_type").orderBy(F.col("p_size") % 7 == 0, F.md5(F.concat(F.lit("e1|"), "p_partkey")), "p_partkey")
    return p.withColumn("r", F.row_number().over(w)).where("r <= 20").join(quota, "p_type").where("r <= quota").select("p_partkey", "p_type", "quota")  # no quota is over twenty


@query("title_uniqueness", """
WITH t AS (SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) AS n, count(*) OVER (PARTITION BY p_name, p_brand) AS m FROM part JOIN (SELECT p_partkey AS k, p_brand AS b FROM part) ON k = p_partkey)
SELECT p.p_partkey, CASE WHEN n = 1 THEN p.p_name WHEN m = 1 THEN p.p_name || ' - ' || p_brand ELSE p.p_name || ' - ' || p_brand || ' - ' || p.p_partkey END AS title FROM t JOIN part p ON p.p_partkey = t.p_partkey
""")
def title_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal titles take the next alternative until none are equal. Counts are joined, not sorted."""
    p = table(spark, sf_dir, "part")
    n = p.groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))
    m = p.groupBy("p_name", "p_brand").agg(F.count(F.lit(1)).alias("m"))
    title = F.when(F.col("n") == 1, F.col("p_name")).when(F.col("m") == 1, F.concat_ws(" - ", "p_name", "p_brand")).otherwise(F.concat_ws(" - ", "p_name", "p_brand", F.col("p_partkey").cast("string")))
    return p.join(n, "p_name").join(m, ["p_name", "p_brand"]).select("p_partkey", title.alias("title"))


@query("related_items", """
WITH x AS (SELECT a.p_partkey, b.p_partkey AS other, CASE WHEN a.p_brand = b.p_brand THEN 0 ELSE 1 END AS rank FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY rank, other) AS n FROM x)
SELECT p_partkey, other, n AS position FROM r WHERE n <= 3
""")
def related_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same name and size, same brand first, three of each. Only the first four of each brand can be among the three, so only those meet all others."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    first = p.withColumn("n", F.row_number().over(Window.partitionBy("p_name", "p_size", "p_brand").orderBy("p_partkey"))).where("n <= 4")
    b = first.select(F.col("p_partkey").alias("other"), "p_name", "p_size", F.col("p_brand").alias("b2"))
    w = Window.partitionBy("p_partkey").orderBy(F.when(F.col("p_brand") == F.col("b2"), 0).otherwise(1), "other")
    x = p.join(b, ["p_name", "p_size"]).where("p_partkey <> other").withColumn("position", F.row_number().over(w).cast("long"))
    return x.where("position <= 3").select("p_partkey", "other", "position")


@query("operations_report", f"""
SELECT 'status' AS section, event_type AS key, count(*) AS n, sum(floor(value * 100 + 0.5)::BIGINT)::BIGINT AS cost_cents FROM events WHERE ts >= {AS_OF_SQL} - INTERVAL 7 DAY GROUP BY event_type
UNION ALL SELECT 'model', 'm' || (CAST(props->>'$.k' AS BIGINT) % 4), count(*), sum(floor(value * 100 + 0.5)::BIGINT)::BIGINT FROM events WHERE ts >= {AS_OF_SQL} - INTERVAL 7 DAY GROUP BY 2
""")
def operations_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week by status and by model, from one grouping."""
    e = table(spark, sf_dir, "events")
    week = e.where(F.col("ts") >= as_of(e) - F.expr("INTERVAL 7 DAY")).select("event_type", F.concat(F.lit("m"), json_int(F.col("props"), "$.k") % 4).alias("model"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("c"))
    g = week.groupingSets([[F.col("event_type")], [F.col("model")]], "event_type", "model").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("cost_cents"))
    return g.select(F.when(F.col("event_type").isNull(), "model").otherwise("status").alias("section"), F.coalesce("event_type", "model").alias("key"), "n", "cost_cents")


@query("opportunities", """
WITH t AS (SELECT CAST(props->>'$.k' AS BIGINT) AS k, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS ok FROM events WHERE event_type IN ('click', 'error') GROUP BY 1)
SELECT k, n, CASE WHEN n >= 100 THEN 'CONTENT' WHEN n >= 20 AND 100 * ok < 60 * n THEN 'HARD_TOPIC' WHEN n >= 20 THEN 'WATCH' ELSE 'NONE' END AS opportunity FROM t
""")
def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of 100, of 20, and of 60 per cent."""
    t = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "error")).groupBy(json_int(F.col("props"), "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "click").alias("ok"))
    kind = F.when(F.col("n") >= 100, "CONTENT").when((F.col("n") >= 20) & (100 * F.col("ok") < 60 * F.col("n")), "HARD_TOPIC").when(F.col("n") >= 20, "WATCH").otherwise("NONE")
    return t.select("k", "n", kind.alias("opportunity"))


@query("length_cue", """
WITH o AS (SELECT l_orderkey, l_linenumber % 4 AS pos, max(l_quantity) AS len FROM lineitem GROUP BY ALL), i AS (SELECT l_orderkey, arg_max(pos, (len, -pos)) AS longest, max(len) AS most, avg(len) AS mean FROM o GROUP BY l_orderkey HAVING count(*) = 4)
SELECT longest, count(*) AS n, 5 * count(*) > 2 * sum(count(*)) OVER () AS too_many, count(*) FILTER (WHERE most > 1.8 * mean) AS n_cues FROM i GROUP BY longest
""")
def length_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose longest option gives the answer away, and positions that hold it in over 40 per cent of a set."""
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") % 4).alias("pos")).agg(F.max("l_quantity").alias("len"))
    i = o.groupBy("l_orderkey").agg(F.max_by("pos", F.struct("len", (-F.col("pos")).alias("m"))).alias("longest"), F.max("len").alias("most"), F.avg("len").alias("mean"), F.count(F.lit(1)).alias("k")).where("k = 4")
    g = i.groupBy("longest").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("most") > 1.8 * F.col("mean")).alias("n_cues"))
    return g.select("longest", "n", (5 * F.col("n") > 2 * F.sum("n").over(Window.partitionBy())).alias("too_many"), "n_cues")


@query("typed_coercion", """
SELECT event_id, TRY_CAST(props->>'$.k' AS BIGINT) AS k, TRY_CAST(props->>'$.missing' AS DOUBLE) AS missing, TRY_CAST(substr(props, 2, 3) AS BIGINT) IS NULL AS unreadable FROM events
""")
def typed_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed schema; what doesn't fit is null."""
    x = F.from_json("props", "k bigint, missing double")
    return table(spark, sf_dir, "events").select("event_id", x["k"].alias("k"), x["missing"].alias("missing"), F.substring("props", 2, 3).try_cast("bigint").isNull().alias("unreadable"))


@query("sitemap_groups", r"""
SELECT regexp_extract(url, '://[^/]+/([a-z]+)/', 1) AS kind, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host, count(*) AS n_urls, ceil(count(*) / 50000.0)::BIGINT AS n_files, max(page_id) AS last_page FROM pages GROUP BY ALL
""")
def sitemap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10, in part: urls by kind and host, in files of 50,000."""
    part = lambda p: F.regexp_extract("url", p, 1)
    g = table(spark, sf_dir, "pages").groupBy(part("://[^/]+/([a-z]+)/").alias("kind"), F.lower(part("://([^/?#]+)")).alias("host"))
    return g.agg(F.count(F.lit(1)).alias("n_urls"), F.ceil(F.count(F.lit(1)) / 50000).cast("long").alias("n_files"), F.max("page_id").alias("last_page"))


@query("seo_gate", """
SELECT doc_id, (length(text) > 600)::INT + (lang IS NOT NULL)::INT + (regexp_matches(text, '[0-9]'))::INT AS useful, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) >= 90 AND count(*) OVER (PARTITION BY substr(text, 1, 50)) = 1 AS publishable FROM documents
""")
def seo_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Useful fields, ninety words and a beginning of its own."""
    d = table(spark, sf_dir, "documents").withColumn("head", F.substring("text", 1, 50))
    n = d.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    useful = (F.char_length("text") > 600).cast("int") + F.col("lang").isNotNull().cast("int") + F.col("text").rlike("[0-9]").cast("int")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) >= 90
    return d.select("doc_id", "head", useful.alias("useful"), words.alias("words")).join(n, "head").select("doc_id", "useful", (F.col("words") & (F.col("n") == 1)).alias("publishable"))


@query("next_competency", """
WITH s AS (SELECT user_id, CAST(props->>'$.k' AS BIGINT) % 6 AS c, avg(value) AS m FROM events GROUP BY ALL), g AS (SELECT u.user_id, k.c, m, k.c < 2 AS is_key FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(0, 6)) AS c) k LEFT JOIN s ON s.user_id = u.user_id AND s.c = k.c)
SELECT user_id, c::BIGINT AS competency, m IS NULL AS untrained FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m IS NOT NULL, CASE WHEN m IS NULL THEN NOT is_key END, round(m, 6), c) AS n FROM g) WHERE n = 1
""")
def next_competency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untrained competencies first, key ones before others, then the weakest."""
    e = table(spark, sf_dir, "events")
    s = e.groupBy("user_id", (json_int(F.col("props"), "$.k") % 6).alias("c")).agg(F.avg("value").alias("m"))
    g = e.select("user_id").distinct().withColumn("c", F.explode(F.array(*[F.lit(i).cast("long") for i in range(6)]))).join(s, ["user_id", "c"], "left")
    w = Window.partitionBy("user_id").orderBy(F.col("m").isNotNull(), F.when(F.col("m").isNull(), F.col("c") >= 2), F.round("m", 6), "c")
    return g.withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", F.col("c").alias("competency"), F.col("m").isNull().alias("untrained"))
