"""Coverage towards mock exams, selections, training weeks, states of content, interview figures, mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import json_int
from ..registry import query, table
from .items import _MADE_SQL, made_items

#: Kinds of session by mode, and what a group of posts asks for (fixed values).
SESSIONS = {"medida": "CUSTOM", "tema": "TRAINING", "art": "TRAINING", "favoritas": "CUSTOM", "fallos": "WEAKNESS", "repaso": "REVIEW", "simulacro": "SIMULATION", "examen": "SIMULATION", "oficial": "OFFICIAL_EXAM", "rapido": "QUICK_TEST", "muestra": "QUICK_TEST"}
STUDIES = {"A1": "Grado universitario", "A2": "Grado universitario", "B": "Técnico Superior", "C1": "Bachiller o Técnico", "C2": "ESO o equivalente", "E": "Sin titulación específica", "AP": "Sin titulación específica"}
ADMINISTRATIONS = {"estatal": "estatal", "seguridad": "estatal", "autonomico": "autonomica", "local": "local"}
_TEXT_MAP = lambda m: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in m.items()) + "}"


def mapped(names: dict[str, str], key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key), default)


@query("mappings", f"WITH c AS (SELECT c_custkey, CASE c_custkey % 12 {' '.join(f'''WHEN {i} THEN '{m}' ''' for i, m in enumerate(SESSIONS))} ELSE 'nada' END AS mode, CASE c_custkey % 9 {' '.join(f'''WHEN {i} THEN '{'subgrupo ' if i % 2 else ''}{g.lower()}' ''' for i, g in enumerate(STUDIES))} END AS grp, CASE c_custkey % 5 {' '.join(f'''WHEN {i} THEN '{a}' ''' for i, a in enumerate(ADMINISTRATIONS))} ELSE 'otro' END AS scope FROM customer)\nSELECT c_custkey, coalesce({_TEXT_MAP(SESSIONS)}[mode], 'CUSTOM') AS session, coalesce({_TEXT_MAP(STUDIES)}[regexp_replace(upper(coalesce(grp, '')), '^SUBGRUPO\\s*', '')], '') AS studies, coalesce({_TEXT_MAP(ADMINISTRATIONS)}[scope], CASE WHEN c_custkey % 3 = 0 THEN 'universidades' ELSE 'estatal' END) AS administration FROM c")
def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's kind by its mode, studies by a group's code, the administration by scope, else by category."""
    i = F.col("c_custkey")
    pick = lambda names, n, rest: mapped({str(k): v for k, v in enumerate(names)}, (i % n).cast("string"), rest)
    groups = [f"{'subgrupo ' if k % 2 else ''}{g.lower()}" for k, g in enumerate(STUDIES)]
    c = table(spark, sf_dir, "customer").select("c_custkey", pick(SESSIONS, 12, F.lit("nada")).alias("mode"), pick(groups, 9, F.lit(None)).alias("grp"), pick(ADMINISTRATIONS, 5, F.lit("otro")).alias("scope"))
    code = F.regexp_replace(F.upper(F.coalesce("grp", F.lit(""))), r"^SUBGRUPO\s*", "")
    category = F.when(i % 3 == 0, "universidades").otherwise("estatal")
    return c.select("c_custkey", mapped(SESSIONS, F.col("mode"), F.lit("CUSTOM")).alias("session"), mapped(STUDIES, code, F.lit("")).alias("studies"), mapped(ADMINISTRATIONS, F.col("scope"), category).alias("administration"))


#: Mock exams wanted without a shared question, questions a section, fewest for a test.
MOCKS, EACH, FEWEST = 3, 4, 20


def coverage_360(topics: DataFrame, questions: int = 30) -> DataFrame:
    """Each topic's target, what is missing, priority, share, and how many mock exams without a shared question it allows.

    ``topics``: topic, valid, official, sections, capacity, weight (of the exam), has_source. The target is what the mock
    exams need or the sections' least, within capacity.
    """
    total = F.sum("valid").over(Window.partitionBy())  # one row per topic
    target = F.least("capacity", F.greatest(EACH * F.col("sections"), F.ceil(questions * F.col("weight") * MOCKS)))
    t = topics.withColumns({"target": target.cast("long"), "share": F.when(total > 0, F.col("valid") / total).otherwise(0.0)})
    missing = F.greatest(F.lit(0), F.col("target") - F.col("valid"))
    priority = F.when(~F.col("has_source"), "P1").when(F.col("valid") + F.col("official") < FEWEST, "P0").when(F.col("valid") < 0.5 * F.col("target"), "P1").when(missing > 0, "P2").otherwise("P3")
    crowded = (F.col("valid") >= 10) & (F.col("weight") > 0) & (F.col("share") > 2 * F.col("weight"))
    mocks = F.when(F.col("weight") > 0, F.floor(F.col("valid") / (questions * F.col("weight")) + 1e-9))
    return t.select("topic", "target", missing.cast("long").alias("missing"), priority.alias("priority"), crowded.alias("crowded"), mocks.alias("mocks"))


@query("topic_coverage", f"WITH t AS (SELECT p_size AS topic, count(*) FILTER (WHERE p_brand <> 'Brand#1') AS valid, count(*) FILTER (WHERE p_brand = 'Brand#2') AS official, (p_size % 7)::BIGINT AS sections, (15 + p_size % 40)::BIGINT AS capacity, (p_size % 10) / 100.0::DOUBLE AS weight, p_size % 13 <> 0 AS has_source FROM part GROUP BY p_size),\nx AS (SELECT *, least(capacity, greatest({EACH} * sections, ceil(30 * weight * {MOCKS})))::BIGINT AS target, valid / sum(valid) OVER () AS share FROM t)\nSELECT topic, target, greatest(0, target - valid)::BIGINT AS missing, CASE WHEN NOT has_source THEN 'P1' WHEN valid + official < {FEWEST} THEN 'P0' WHEN valid < 0.5 * target THEN 'P1' WHEN target > valid THEN 'P2' ELSE 'P3' END AS priority, valid >= 10 AND weight > 0 AND share > 2 * weight AS crowded, CASE WHEN weight > 0 THEN floor(valid / (30 * weight) + 1e-9)::BIGINT END AS mocks FROM x")
def topic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example topics, the sizes of parts."""
    size = F.col("p_size")
    n = lambda c: F.count_if(c)
    t = table(spark, sf_dir, "part").groupBy(size.alias("topic")).agg(n(F.col("p_brand") != "Brand#1").alias("valid"), n(F.col("p_brand") == "Brand#2").alias("official"))
    t = t.select("*", (F.col("topic") % 7).cast("long").alias("sections"), (15 + F.col("topic") % 40).cast("long").alias("capacity"), (F.col("topic") % 10 / F.lit(100.0)).alias("weight"), (F.col("topic") % 13 != 0).alias("has_source"))
    return coverage_360(t)


def mock_selection(items: DataFrame, n: int, reserve: int = 0) -> DataFrame:
    """``n`` items and a reserve: item, topic, place (null in the reserve).

    A topic has its share of ``n``, at least one if there is room for all; places left go to the largest topics. Of a
    topic those not answered in the last seven days come first (``recent`` false), then by a hash. If a topic has too few,
    others fill up. Only the first ``n`` of a topic are looked at, so that no task sorts more.
    """
    order = ["recent", F.md5(F.concat(F.lit("m1|"), F.col("item").cast("string"))), "item"]
    sizes = items.groupBy("topic").agg(F.count(F.lit(1)).alias("size"))
    all_rows = Window.partitionBy()  # one row per topic
    base = F.floor(n * F.col("size") / F.sum("size").over(all_rows))
    quota = F.when((base == 0) & (F.count(F.lit(1)).over(all_rows) <= n), 1).otherwise(base)
    quotas = sizes.withColumn("quota", quota).withColumn("spare", F.greatest(n - F.sum("quota").over(all_rows), F.lit(0)))
    quotas = quotas.withColumn("quota", F.col("quota") + (F.row_number().over(Window.orderBy(F.desc("size"), "topic")) <= F.col("spare")).cast("long"))
    ranked = items.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(*order))).where(F.col("r") <= n + reserve).join(quotas.select("topic", "quota"), "topic")
    placed = ranked.withColumn("late", F.col("r") > F.col("quota")).orderBy("late", *order).limit(n + reserve)
    return placed.withColumn("p", F.row_number().over(Window.orderBy("late", *order))).select("item", "topic", F.when(F.col("p") <= n, F.col("p")).cast("long").alias("place"))


@query("mock_selection", """WITH i AS (SELECT p_partkey AS item, p_type AS topic, p_size % 7 = 0 AS recent, md5('m1|' || p_partkey) AS h FROM part), s AS (SELECT topic, count(*) AS size FROM i GROUP BY topic), b AS (SELECT *, CASE WHEN floor(30 * size / sum(size) OVER ()) = 0 AND count(*) OVER () <= 30 THEN 1 ELSE floor(30 * size / sum(size) OVER ())::BIGINT END AS q FROM s),
d AS (SELECT topic, q + CASE WHEN row_number() OVER (ORDER BY size DESC, topic) <= greatest(30 - sum(q) OVER (), 0) THEN 1 ELSE 0 END AS quota FROM b), r AS (SELECT i.*, quota, row_number() OVER (PARTITION BY i.topic ORDER BY recent, h, item) AS r FROM i JOIN d ON d.topic = i.topic), p AS (SELECT item, topic, row_number() OVER (ORDER BY r > quota, recent, h, item) AS p FROM r WHERE r <= 35)
SELECT item, topic, CASE WHEN p <= 30 THEN p END AS place FROM p WHERE p <= 35""")
def mock_exam_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty items and a reserve of five."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_type").alias("topic"), (F.col("p_size") % 7 == 0).alias("recent"))
    return mock_selection(p, 30, 5)


def training_sessions(plans: DataFrame, most: int = 6) -> DataFrame:
    """The next sessions of a plan: id, day, week, phase, test.

    ``plans``: id, today, exam (a date or null), tests (the weakest first). Weeks to the exam, 1 to 16, 12 without one;
    the last of more than two is for tapering, the others go through base, development and peak by their share; Mondays,
    Wednesdays and Fridays, but only Mondays and an easy Wednesday at the end; days gone by are left out.
    """
    weeks = F.when(F.col("exam").isNull(), 12).otherwise(F.greatest(F.lit(1), F.least(F.lit(16), F.floor(F.datediff("exam", "today") / 7)))).cast("int")
    p = plans.withColumn("weeks", weeks).withColumn("week", F.explode(F.sequence(F.lit(0), F.col("weeks") - 1)))
    last = (F.col("week") >= F.col("weeks") - 1) & (F.col("weeks") > 2)
    stage = F.least(F.lit(2), F.floor(F.col("week") * 3 / F.greatest(F.lit(1), F.col("weeks") - 1)))
    phase = F.when(last, "puesta").when(stage == 0, "base").when(stage == 1, "desarrollo").otherwise("pico")
    p = p.withColumn("phase", phase).withColumn("k", F.explode(F.when(last, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))))
    test = F.when(last & (F.col("k") == 1), "descanso").otherwise(F.get("tests", F.col("k") % F.size("tests")))
    monday = F.date_trunc("week", "today").cast("date")
    s = p.select("id", F.date_add(monday, F.col("week") * 7 + 2 * F.col("k")).alias("day"), (F.col("week") + 1).alias("week"), "phase", test.alias("test"), "today").where("day >= today")
    return s.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("day"))).where(F.col("r") <= most).select("id", "day", "week", "phase", "test")


@query("training_weeks", """WITH p AS (SELECT s_suppkey AS id, DATE '2024-03-01' + (s_suppkey % 9)::INTEGER AS today, CASE WHEN s_suppkey % 4 <> 0 THEN DATE '2024-03-01' + (s_suppkey * 3 % 140)::INTEGER END AS exam, CASE WHEN s_suppkey % 2 = 0 THEN ['natacion', 'carrera'] ELSE ['fuerza', 'carrera', 'salto', 'natacion'] END AS tests FROM supplier),
w AS (SELECT *, CASE WHEN exam IS NULL THEN 12 ELSE greatest(1, least(16, floor((exam - today) / 7.0))) END::INTEGER AS weeks FROM p), x AS (SELECT *, unnest(range(weeks)) AS week FROM w), y AS (SELECT *, week >= weeks - 1 AND weeks > 2 AS final, least(2, floor(week * 3.0 / greatest(1, weeks - 1))) AS stage FROM x), z AS (SELECT *, unnest(CASE WHEN final THEN [0, 1] ELSE [0, 1, 2] END) AS k FROM y),
s AS (SELECT id, (date_trunc('week', today)::DATE + (week * 7 + 2 * k)::INTEGER)::DATE AS day, (week + 1)::INTEGER AS week, CASE WHEN final THEN 'puesta' WHEN stage = 0 THEN 'base' WHEN stage = 1 THEN 'desarrollo' ELSE 'pico' END AS phase, CASE WHEN final AND k = 1 THEN 'descanso' ELSE tests[1 + k % len(tests)] END AS test, today FROM z)
SELECT id, day, week, phase, test FROM s WHERE day >= today QUALIFY row_number() OVER (PARTITION BY id ORDER BY day) <= 6""")
def training_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example plans of physical training."""
    k = F.col("s_suppkey")
    day = F.lit("2024-03-01").cast("date")
    tests = F.when(k % 2 == 0, F.array(F.lit("natacion"), F.lit("carrera"))).otherwise(F.array(*map(F.lit, ("fuerza", "carrera", "salto", "natacion"))))
    return training_sessions(table(spark, sf_dir, "supplier").select(k.alias("id"), F.date_add(day, (k % 9).cast("int")).alias("today"), F.when(k % 4 != 0, F.date_add(day, (k * 3 % 140).cast("int"))).alias("exam"), tests.alias("tests")))


def content_fold(actions: Column) -> Column:
    """Actions in order to the last state, how many changes it took and how many actions its state refused.

    approve: from HUMAN_REVIEW, REJECTED or DRAFT, and then scheduled; reschedule: from APPROVED or SCHEDULED; publish: from
    SCHEDULED; edit: back to HUMAN_REVIEW; reject and archive: from anywhere.
    """
    zero = F.struct(F.lit("HUMAN_REVIEW").alias("state"), F.lit(0).alias("changes"), F.lit(0).alias("refused"))

    def step(s: Column, a: Column) -> Column:
        now = s["state"]
        to = (
            F.when(a == "reject", "REJECTED").when(a == "archive", "ARCHIVED").when(a == "edit", "HUMAN_REVIEW").when((a == "approve") & now.isin("HUMAN_REVIEW", "REJECTED", "DRAFT"), "SCHEDULED")
            .when((a == "reschedule") & now.isin("APPROVED", "SCHEDULED"), "SCHEDULED").when((a == "publish") & (now == "SCHEDULED"), "PUBLISHED")
        )
        return F.struct(F.coalesce(to, now).alias("state"), (s["changes"] + to.isNotNull().cast("int")).alias("changes"), (s["refused"] + to.isNull().cast("int")).alias("refused"))

    return F.aggregate(actions, zero, step)


_ACTIONS = "CASE event_type WHEN 'view' THEN 'approve' WHEN 'click' THEN 'reschedule' WHEN 'purchase' THEN 'publish' WHEN 'signup' THEN 'edit' ELSE CASE WHEN event_id % 2 = 0 THEN 'reject' ELSE 'archive' END END"


@query("content_transitions", f"""WITH RECURSIVE a AS (SELECT user_id, {_ACTIONS} AS act, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s(user_id, i, state, changes, refused) AS (SELECT DISTINCT user_id, 0::BIGINT, 'HUMAN_REVIEW', 0, 0 FROM a UNION ALL SELECT user_id, i, coalesce(t, state), changes + (t IS NOT NULL)::INT, refused + (t IS NULL)::INT FROM (SELECT s.user_id, a.i, state, changes, refused, CASE WHEN act = 'reject' THEN 'REJECTED' WHEN act = 'archive' THEN 'ARCHIVED' WHEN act = 'edit' THEN 'HUMAN_REVIEW' WHEN act = 'approve' AND state IN ('HUMAN_REVIEW', 'REJECTED', 'DRAFT') THEN 'SCHEDULED' WHEN act = 'reschedule' AND state IN ('APPROVED', 'SCHEDULED') THEN 'SCHEDULED' WHEN act = 'publish' AND state = 'SCHEDULED' THEN 'PUBLISHED' END AS t FROM s JOIN a ON a.user_id = s.user_id AND a.i = s.i + 1))
SELECT user_id, state, changes, refused FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def content_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each content's history leads; an action that its state doesn't allow changes nothing."""
    a = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", F.expr(_ACTIONS).alias("act")).alias("a"))
    h = a.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("a")), lambda x: x["act"]).alias("acts"))
    return h.select("user_id", content_fold(F.col("acts")).alias("s")).select("user_id", "s.*")


@query("interview_metrics", """WITH e AS (SELECT user_id, CAST(props->>'$.k' AS BIGINT) % 5 AS competency, CAST(props->>'$.k' AS BIGINT) % 3 AS dimension, floor(value) % 11 AS score, ts::DATE AS session FROM events WHERE event_type IN ('click', 'view')),
c AS (SELECT user_id, competency, floor(10 * avg(score) + 0.5) / 10 AS mean FROM e GROUP BY ALL), d AS (SELECT user_id, dimension, floor(10 * avg(score) + 0.5) / 10 AS mean FROM e GROUP BY ALL), s AS (SELECT user_id, session, floor(10 * avg(score) + 0.5) / 10 AS mean FROM e GROUP BY ALL), t AS (SELECT *, lag(mean) OVER (PARTITION BY user_id ORDER BY session) AS before, row_number() OVER (PARTITION BY user_id ORDER BY session DESC) AS r FROM s)
SELECT c.user_id, count(*) AS n_competencies, arg_min(competency, (c.mean, competency)) AS weakest, count(*) FILTER (WHERE c.mean >= 7) AS strong, any_value(w.area) AS weakest_area, any_value(t.mean) AS last_mean, any_value(round(t.mean - t.before, 1)) AS trend FROM c JOIN (SELECT user_id, arg_min(dimension, (mean, dimension)) AS area FROM d GROUP BY user_id) w ON w.user_id = c.user_id JOIN t ON t.user_id = c.user_id AND r = 1 GROUP BY c.user_id""")
def interview_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by competency and by dimension with one decimal, the weakest of each, the last session and its step from the one before."""
    k = json_int(F.col("props"), "$.k")
    e = table(spark, sf_dir, "events").where("event_type IN ('click', 'view')").select("user_id", (k % 5).alias("competency"), (k % 3).alias("dimension"), (F.floor("value") % 11).alias("score"), F.to_date("ts").alias("session"))
    mean = (F.floor(10 * F.avg("score") + 0.5) / 10).alias("mean")
    by = lambda key: e.groupBy("user_id", key).agg(mean)
    c = by("competency").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_competencies"), F.min_by("competency", F.struct("mean", "competency")).alias("weakest"), F.count_if(F.col("mean") >= 7).alias("strong"))
    d = by("dimension").groupBy("user_id").agg(F.min_by("dimension", F.struct("mean", "dimension")).alias("weakest_area"))
    w = Window.partitionBy("user_id").orderBy("session")  # a learner's sessions
    s = by("session").withColumn("before", F.lag("mean").over(w)).groupBy("user_id").agg(F.max_by(F.struct("mean", "before"), "session").alias("last"))
    return c.join(d, "user_id").join(s, "user_id").select("user_id", "n_competencies", "weakest", "strong", "weakest_area", F.col("last.mean").alias("last_mean"), F.round(F.col("last.mean") - F.col("last.before"), 1).alias("trend"))


@query("scenario_choice", f"WITH {_MADE_SQL}, s AS (SELECT id, law AS competency, kind AS category FROM m), w AS (SELECT competency, count(*) % 5 AS strength FROM s GROUP BY competency), f AS (SELECT competency, arg_min(id, (md5('e1|' || id), id)) AS pick FROM s GROUP BY competency), o AS (SELECT competency, row_number() OVER (ORDER BY strength, competency) AS place FROM w)\nSELECT 'mixta' AS mode, pick AS id, place FROM f JOIN o USING (competency) WHERE place <= 5 UNION ALL SELECT 'practica', id, row_number() OVER (ORDER BY md5('e1|' || id), id) AS p FROM s WHERE competency = 'ley2' QUALIFY p <= 3 UNION ALL SELECT 'dificiles', id, row_number() OVER (ORDER BY md5('e1|' || id), id) AS p FROM s WHERE category = 'excepcion' QUALIFY p <= 4 UNION ALL SELECT 'simulada', pick, row_number() OVER (ORDER BY competency <> 'ley1', place) AS p FROM f JOIN o USING (competency) QUALIFY p <= 8")
def scenario_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios of a session by mode: one of each of the weakest competencies, or some of one competency, or some of the hard categories; a simulated session opens with the motivation's (here ley1), then one of each weakest up to eight."""
    s = made_items(spark, sf_dir).select("id", F.col("law").alias("competency"), F.col("kind").alias("category"), F.md5(F.concat(F.lit("e1|"), "id")).alias("h"))
    each = s.groupBy("competency").agg((F.count(F.lit(1)) % 5).alias("strength"), F.min(F.struct("h", "id"))["id"].alias("id"))
    mixed = each.orderBy("strength", "competency").limit(5).select(F.lit("mixta").alias("mode"), "id", F.row_number().over(Window.orderBy("strength", "competency")).cast("long").alias("place"))
    opening = F.col("competency") != "ley1"
    whole = each.orderBy(opening, "strength", "competency").limit(8).select(F.lit("simulada").alias("mode"), "id", F.row_number().over(Window.orderBy(opening, "strength", "competency")).cast("long").alias("place"))
    some = lambda mode, df, n: df.orderBy("h", "id").limit(n).select(F.lit(mode).alias("mode"), "id", F.row_number().over(Window.orderBy("h", "id")).cast("long").alias("place"))
    return mixed.unionByName(whole).unionByName(some("practica", s.where("competency = 'ley2'"), 3)).unionByName(some("dificiles", s.where("category = 'excepcion'"), 4))


@query("run_metrics", "WITH d AS (SELECT source, CASE WHEN lang = 'fr' THEN 'new' WHEN lang = 'de' THEN 'changed' ELSE 'same' END AS state, n_chars = 0 OR doc_id % 97 = 0 AS failed FROM documents) SELECT source, count(*) FILTER (WHERE state = 'new') AS new, count(*) FILTER (WHERE state = 'changed') AS changed, count(*) FILTER (WHERE state = 'same') AS same, count(*) FILTER (WHERE failed) AS failures, CASE WHEN count(*) FILTER (WHERE failed) >= 1 THEN 'error' ELSE 'ok' END AS status FROM d GROUP BY source")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run found in each source, and whether the source fails."""
    lang = F.col("lang")
    d = table(spark, sf_dir, "documents").select("source", F.when(lang == "fr", "new").when(lang == "de", "changed").otherwise("same").alias("state"), ((F.col("n_chars") == 0) | (F.col("doc_id") % 97 == 0)).alias("failed"))
    g = d.groupBy("source").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("new", "changed", "same")], F.count_if("failed").alias("failures"))
    return g.withColumn("status", F.when(F.col("failures") >= 1, "error").otherwise("ok"))


@query("sitemap_lines", r"WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'noticias' WHEN 1 THEN 'leyes' ELSE 'temas' END AS kind, DATE '2024-01-01' + (page_id % 50)::INTEGER AS changed FROM pages), n AS (SELECT *, (row_number() OVER (PARTITION BY kind ORDER BY page_id) - 1) // 40 AS part FROM u) SELECT 'sitemap-' || kind || '-' || (part + 1) || '.xml' AS file, md5(string_agg('<url><loc>https://site.test/' || kind || '/' || page_id || '/</loc><lastmod>' || changed || '</lastmod></url>', chr(10) ORDER BY page_id)) AS body_md5, count(*) AS n, max(changed) AS changed FROM n GROUP BY kind, part")
def sitemap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a sitemap, each of one kind and bounded, with their lines; pages are numbered by ranges."""
    from ..tables import number_rows

    i = F.col("page_id")
    u = table(spark, sf_dir, "pages").select("page_id", F.when(i % 3 == 0, "noticias").when(i % 3 == 1, "leyes").otherwise("temas").alias("kind"), F.date_add(F.lit("2024-01-01").cast("date"), (i % 50).cast("int")).alias("changed"))
    n = number_rows(u, ["kind", "page_id"])
    first = n.groupBy("kind").agg(F.min("row_number").alias("first"))
    n = n.join(first, "kind").withColumn("part", F.floor((F.col("row_number") - F.col("first")) / 40) + 1)
    line = F.concat(F.lit("<url><loc>https://site.test/"), "kind", F.lit("/"), "page_id", F.lit("/</loc><lastmod>"), "changed", F.lit("</lastmod></url>"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", line.alias("line")))), lambda x: x["line"]), "\n")  # forty lines a file
    return n.groupBy(F.concat(F.lit("sitemap-"), "kind", F.lit("-"), "part", F.lit(".xml")).alias("file")).agg(F.md5(lines).alias("body_md5"), F.count(F.lit(1)).alias("n"), F.max("changed").alias("changed"))
