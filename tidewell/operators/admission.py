"""Rules at the doors: what a browser may log, whose call it is, the first links of a listing, series of last values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import json_int
from ..registry import query, table

#: Types that a browser may log, and those of them that need a session (fixed values).
BROWSER_TYPES = ("PAGE_VIEW", "LANDING_VISIT", "SEARCH", "OPPOSITION_VIEW", "TEST_STARTED", "TEST_COMPLETED", "SIMULATION_STARTED", "SIMULATION_COMPLETED", "PAYWALL_REACHED", "FREE_LIMIT_REACHED", "ONBOARDING_COMPLETED", "CHECKOUT_STARTED", "USER_REGISTERED", "USER_ACTIVATED", "EXPERIMENT_EXPOSURE")
SESSION_TYPES = ("USER_REGISTERED", "USER_ACTIVATED")
#: Patterns of administrations (fixed values).
LOCAL = "(?i)ayuntamiento|diputaci|cabildo|consell (insular|comarcal)|comarca|mancomunidad|entidad local|concello|ajuntament"
UNIVERSITY = "(?i)universi(dad|tat|dade)"
REGIONAL = "(?i)comunidad aut[oó]noma|junta de|generalitat|gobierno de|xunta|principado|regi[oó]n de murcia|comunidad de madrid|comunidad foral|govern|servicio .{0,20}salud|osakidetza"


def admitted(events: DataFrame) -> DataFrame:
    """The events with ``verdict``, entity fields cut to 40 and 120 characters, and the key under which one is stored once.

    ``events``: type, session (user or null), anon, payload, metadata, entity, entity_id, key (or null). Checks in order:
    the type, a session where it is needed, the form of the device id, 2,048 bytes of payload and 4,096 of metadata.
    """
    size = lambda c: F.octet_length(F.coalesce(c, F.lit("{}")))
    verdict = (
        F.when(~F.coalesce(F.col("type").isin(*BROWSER_TYPES), F.lit(False)), "type")
        .when(F.col("type").isin(*SESSION_TYPES) & F.col("session").isNull(), "session")
        .when(~F.coalesce(F.col("anon").rlike("^[a-z0-9]{16,40}$"), F.lit(False)), "anon_id")
        .when((size("payload") > 2048) | (size("metadata") > 4096), "size")
        .otherwise("ok")
    )
    key = F.concat(F.lit("web:"), F.coalesce(F.col("session").cast("string"), "anon"), F.lit(":"), F.substring("key", 1, 120))
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    return events.withColumns({"verdict": verdict, "entity": cut("entity", 40), "entity_id": cut("entity_id", 120), "stored_key": key})


@query("event_admission", f"""
WITH d AS (SELECT doc_id, any_value(text) AS text, any_value(source) AS source FROM documents GROUP BY doc_id),
e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'PAGE_VIEW' WHEN 'click' THEN 'SEARCH' WHEN 'signup' THEN 'USER_REGISTERED' WHEN 'purchase' THEN 'CHECKOUT_STARTED' ELSE 'ERROR' END AS type,
  CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL THEN user_id END AS session, substr(md5(user_id::VARCHAR), 1, 10 + user_id % 30) AS anon, props, text, coalesce(source, '') AS entity, coalesce(text, '') AS entity_id FROM events LEFT JOIN d ON d.doc_id = event_id)
SELECT event_id, CASE WHEN type NOT IN {BROWSER_TYPES} THEN 'type' WHEN type IN {SESSION_TYPES} AND session IS NULL THEN 'session' WHEN NOT regexp_full_match(anon, '[a-z0-9]{{16,40}}') THEN 'anon_id'
  WHEN strlen(coalesce(props, '{{}}')) > 2048 OR strlen(coalesce(text, '{{}}')) > 4096 THEN 'size' ELSE 'ok' END AS verdict, substr(entity, 1, 40) AS entity, md5(substr(entity_id, 1, 120)) AS entity_md5, 'web:' || coalesce(session::VARCHAR, anon) || ':' || substr(props, 1, 120) AS stored_key FROM e
""")
def event_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a browser would log them, a document's text as their metadata; a user has a session once seen before."""
    e, d = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.any_value("text").alias("text"), F.any_value("source").alias("source"))
    names = {"view": "PAGE_VIEW", "click": "SEARCH", "signup": "USER_REGISTERED", "purchase": "CHECKOUT_STARTED"}
    kind = F.lit("ERROR")
    for k, v in names.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    first = e.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    known = e.join(first, "user_id", "left").where("event_id IS NOT NULL")
    session = F.when(F.struct("ts", "event_id") > F.col("first"), F.col("user_id"))
    rows = known.join(d, F.col("doc_id") == F.col("event_id"), "left").select("event_id", kind.alias("type"), session.alias("session"), F.substring(F.md5(F.col("user_id").cast("string")), F.lit(1), (10 + F.col("user_id") % 30).cast("int")).alias("anon"), F.col("props").alias("payload"), F.col("text").alias("metadata"), F.col("source").alias("entity"), F.col("text").alias("entity_id"), F.col("props").alias("key"))
    return admitted(rows).select("event_id", "verdict", "entity", F.md5("entity_id").alias("entity_md5"), "stored_key")


def administration(organ: Column, title: Column) -> Column:
    """P10: local, universities, regional or national, by the organ's name and the title; the organ alone makes a university."""
    both = F.concat(F.coalesce(organ, F.lit("")), F.lit(" "), F.coalesce(title, F.lit("")))
    return F.when(both.rlike(LOCAL), "local").when(F.coalesce(organ, F.lit("")).rlike(UNIVERSITY), "universidades").when(both.rlike(REGIONAL), "autonomica").otherwise("estatal")


#: Beginnings of the example's organs.
ORGANS = ("Ayuntamiento de", "Universitat de", "Junta de", "Ministerio de", "Consell Comarcal de", "Servicio Andaluz de Salud,", "Consorcio", "Principado de")


@query("administration_levels", f"""
WITH c AS (SELECT s_suppkey, [{', '.join(f"'{o}'" for o in ORGANS)}][s_nationkey % 8 + 1] || ' ' || n_name AS organ, d.text AS title FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN (SELECT doc_id, any_value(text) AS text FROM documents GROUP BY doc_id) d ON d.doc_id = s_suppkey)
SELECT s_suppkey, CASE WHEN regexp_matches(organ || ' ' || coalesce(title, ''), '{LOCAL}') THEN 'local' WHEN regexp_matches(organ, '{UNIVERSITY}') THEN 'universidades' WHEN regexp_matches(organ || ' ' || coalesce(title, ''), '{REGIONAL}') THEN 'autonomica' ELSE 'estatal' END AS administration FROM c
""")
def administration_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: suppliers as the organs of calls, with a document's whole text as the call's."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    d = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.any_value("text").alias("text"))
    organ = F.concat_ws(" ", F.get(F.array(*[F.lit(o) for o in ORGANS]), F.col("s_nationkey") % 8), "n_name")
    return s.join(d, F.col("doc_id") == F.col("s_suppkey"), "left").select("s_suppkey", administration(organ, F.col("text")).alias("administration"))


def first_links(html: Column, n: int) -> Column:
    """The first ``n`` different link targets, in the order of the page."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("""<a\\b[^>]*?href=["']([^"']+)["']"""), F.lit(1))), 1, n)


@query("listing_links", """
WITH l AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<a\\b[^>]*?href=["'']([^"'']+)["'']', 1) AS l FROM pages)
SELECT page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:5], chr(10)) AS links FROM l
""")
def listing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crawl of each page as a listing would fetch: its first five different links."""
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(first_links(F.col("html"), 5), "\n").alias("links"))


def last_series(rows: DataFrame, key: str, order: list[str], value: str, n: int = 30) -> DataFrame:
    """Of each key the last ``n`` values in order, and their mean: key, series, mean. Only ranks are sorted by key; a series has ``n`` values at most."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    last = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    s = last.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.negative("_n").alias("n"), F.col(value).alias("v")))).alias("s"))
    series = F.col("s.v")
    return s.select(key, series.alias("series"), (F.aggregate(series, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0))) / F.size(series)).alias("mean"))


@query("evolution_series", """
WITH r AS (SELECT user_id, CAST(props->>'$.k' AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT user_id, string_agg(k::VARCHAR, ',' ORDER BY n DESC) AS series, count(*)::INT AS n_values, round(sum(k) / count(*), 6) AS mean FROM r WHERE n <= 30 GROUP BY user_id
""")
def evolution_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last thirty results in the order of time."""
    e = table(spark, sf_dir, "events").withColumn("k", json_int(F.col("props"), "$.k"))
    s = last_series(e, "user_id", ["ts", "event_id"], "k")
    return s.select("user_id", F.array_join(F.transform("series", lambda x: x.cast("string")), ",").alias("series"), F.size("series").alias("n_values"), F.round("mean", 6).alias("mean"))
