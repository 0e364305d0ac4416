"""Watching official sources: nested records, gazettes with a cursor, classes of source, titles, codes, citations, call records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import FOLD_SQL, fold
from ..registry import query, table
from ..tables import settle
from .items import _FLAT, flat

def descend(rows: DataFrame, document: str, keys: tuple[str, ...]) -> DataFrame:
    """Every object in a JSON text, at any depth, that has all ``keys``: the other columns of ``rows`` and the keys as strings.

    Each level's members become the next level's rows, in Spark, until no row has any.
    """
    spark, own = rows.sparkSession, [c for c in rows.columns if c != document]
    level, out = rows.select(*own, F.col(document).alias("_j")), None
    while True:
        parsed = level.select(*own, F.try_parse_json("_j").alias("_v")).where("_v IS NOT NULL")
        hits = parsed.select(*own, *[F.try_variant_get("_v", f"$.{k}", "string").alias(k) for k in keys]).where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
        out = hits if out is None else out.unionByName(hits)
        inner = parsed.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select(*own, F.col("value").alias("_v")).where(F.schema_of_variant("_v").rlike("^(OBJECT|ARRAY)<"))
        level = settle(inner.select(*own, F.to_json("_v").alias("_j")), "level")
        if level.isEmpty():
            return out


_NESTED = """'{"fecha": "' || (doc_id % 28) || '", "diario": [{"seccion": {"codigo": "' || (doc_id % 3) || 'B", "item": [{"identificador": "A-' || doc_id || '", "titulo": "' || word || '"}, {"identificador": "B-' || doc_id || '", "otro": 1}]}, "departamento": {"item": {"identificador": "C-' || doc_id || '", "titulo": "x", "anexo": {"identificador": "D-' || doc_id || '", "titulo": "y"}}}}]}'"""
_WORD_SQL = "(SELECT doc_id, regexp_replace(substr(coalesce(text, ''), 1, 12), '[^a-zA-Z ]', '-', 'g') AS word FROM documents)"


@query("json_descent", f"""WITH RECURSIVE j AS (SELECT doc_id, {_NESTED} AS j FROM {_WORD_SQL}), n(doc_id, v) AS (SELECT doc_id, j::JSON FROM j UNION ALL SELECT doc_id, unnest(CASE json_type(v) WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: json_extract(v, '$."' || k || '"')) WHEN 'ARRAY' THEN json_extract(v, '$[*]') ELSE [] END) FROM n WHERE json_type(v) IN ('OBJECT', 'ARRAY'))
SELECT doc_id, v->>'$.identificador' AS identificador, v->>'$.titulo' AS titulo FROM n WHERE json_type(v) = 'OBJECT' AND v->>'$.identificador' IS NOT NULL AND v->>'$.titulo' IS NOT NULL""")
def json_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records at any depth of a nested document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 12), "[^a-zA-Z ]", "-").alias("word"))
    return descend(d.selectExpr("doc_id", f"{_NESTED} AS j"), "j", ("identificador", "titulo"))


_GAZETTE_SQL = f"g AS (SELECT doc_id, source, CASE doc_id % 4 WHEN 0 THEN '2B' WHEN 1 THEN '3' ELSE '5A' END AS section, DATE '2024-01-01' + (doc_id % 90)::INTEGER AS day, {FOLD_SQL.format('text')} AS t, doc_id % 7 = 0 AS known FROM documents)"


def crawl(gazette: DataFrame, sections: tuple[str, ...], include: str, exclude: str, most: int) -> DataFrame:
    """What a run takes of each source from its cursor on, and the new cursor.

    ``gazette``: source, day, section, t (title), known. Items of the sections whose title has ``include`` and not
    ``exclude`` and that aren't known are taken day by day, ``most`` at most; the cursor is the last day taken whole. Days
    are counted first, so that what is numbered is one row per source and day.
    """
    fits = F.col("section").isin(*sections) & F.col("t").rlike(include) & ~F.col("t").rlike(exclude) & ~F.col("known")
    days = gazette.groupBy("source", "day").agg(F.count_if(fits).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("source").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    days = days.withColumn("total", so_far)
    return days.groupBy("source").agg(F.max(F.when(F.col("total") <= most, F.col("day"))).alias("cursor"), F.least(F.max("total"), F.lit(most)).alias("taken"), F.max("total").alias("due"))


@query("gazette_cursor", f"""WITH {_GAZETTE_SQL}, d AS (SELECT source, day, count(*) FILTER (WHERE section IN ('2B', '5A') AND regexp_matches(t, 'tion|en') AND NOT regexp_matches(t, 'licen[cs]e') AND NOT known) AS n FROM g GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY day ROWS UNBOUNDED PRECEDING) AS total FROM d)
SELECT source, max(day) FILTER (WHERE total <= 10) AS cursor, least(max(total), 10)::BIGINT AS taken, max(total)::BIGINT AS due FROM s GROUP BY source""")
def gazette_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a limited run over each source gets."""
    section = F.when(F.col("doc_id") % 4 == 0, "2B").when(F.col("doc_id") % 4 == 1, "3").otherwise("5A")
    g = table(spark, sf_dir, "documents").select("doc_id", "source", section.alias("section"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90).cast("int")).alias("day"), fold(F.col("text")).alias("t"), (F.col("doc_id") % 7 == 0).alias("known"))
    return crawl(g, ("2B", "5A"), "tion|en", "licen[cs]e", most=10)


@query("source_classes", r"""WITH s AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Finalizado' WHEN 1 THEN 'Desactualizado' WHEN 2 THEN 'En proceso' END AS state, doc_id % 7 = 0 AS official, regexp_replace(coalesce(text, ''), '\s+', ' ', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN state = 'Finalizado' OR official THEN 'FOUND_OFFICIAL_CONSOLIDATED' WHEN state IS NOT NULL THEN 'FOUND_OFFICIAL_NON_CONSOLIDATED' ELSE 'NOT_FOUND' END AS class, sha256(t) AS version FROM s""")
def source_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a law's source is worth, and the hash that names its version."""
    k = F.col("doc_id") % 5
    s = table(spark, sf_dir, "documents").select("doc_id", F.when(k == 0, "Finalizado").when(k == 1, "Desactualizado").when(k == 2, "En proceso").alias("state"), (F.col("doc_id") % 7 == 0).alias("official"), F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ").alias("t"))
    return s.select("doc_id", source_class(F.col("state"), F.col("official")).alias("class"), F.sha2("t", 256).alias("version"))


def source_class(state: Column, official: Column) -> Column:
    return F.when((state == "Finalizado") | official, "FOUND_OFFICIAL_CONSOLIDATED").when(state.isNotNull(), "FOUND_OFFICIAL_NON_CONSOLIDATED").otherwise("NOT_FOUND")


def prefix_join(rows: DataFrame, code: str, topics: DataFrame, topic: str) -> DataFrame:
    """Rows with each ``topic`` that is their dotted code or a beginning of it; codes are taken apart, so that the join has a key."""
    parts = F.split(code, r"\.")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    return rows.withColumn("_start", F.explode(starts)).join(topics, F.col("_start") == F.col(topic)).drop("_start")


@query("prefix_topics", """WITH c AS (SELECT p_partkey, chr((65 + p_partkey % 3)::INTEGER) || '.' || (p_partkey % 12) || '.' || p_size AS code FROM part), t AS (SELECT DISTINCT chr((65 + n_nationkey % 3)::INTEGER) || CASE WHEN n_nationkey >= 3 THEN '.' || (n_nationkey % 12) ELSE '' END AS topic FROM nation)
SELECT topic, count(*) AS n, min(p_partkey) AS first_part FROM c JOIN t ON code = topic OR starts_with(code, topic || '.') GROUP BY topic""")
def prefix_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts under each topic, by code."""
    c = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.char(65 + F.col("p_partkey") % 3), F.lit("."), F.col("p_partkey") % 12, F.lit("."), "p_size").alias("code"))
    n = F.col("n_nationkey")
    t = table(spark, sf_dir, "nation").select(F.concat(F.char(65 + n % 3), F.when(n >= 3, F.concat(F.lit("."), n % 12)).otherwise("")).alias("topic")).distinct()
    return prefix_join(c, "code", t, "topic").groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_part"))


#: Example watches: a name, the reference of its own call, and groups of words, of which all of one must occur.
WATCHES = (("uno", ("en", "re"), (("tion", "the"), ("der", "und"))), ("dos", ("que",), (("les", "des"), ("que", "los"))), ("tres", ("zz",), (("data",), ("de", "la", "el"))))


@query("title_groups", "WITH t AS (SELECT doc_id, lower(regexp_replace(substr(coalesce(text, ''), 1, 120), '^[^,]*,', '')) AS body, " + FOLD_SQL.format("substr(coalesce(text, ''), 1, 120)") + " AS title, contains(substr(coalesce(text, ''), 1, 120), ',') AS cut FROM documents)\n" + " UNION ALL ".join(
    f"SELECT doc_id, '{name}' AS watch, CASE WHEN {' OR '.join(f'''contains(body, '{r}')''' for r in refs)} THEN 'convocatoria' ELSE 'cuerpo' END AS relevance FROM t WHERE {' OR '.join('(' + ' AND '.join(f'''contains(title, '{w}')''' for w in g) + ')' for g in groups)}" for name, refs, groups in WATCHES))
def title_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that match a watch, any of its groups with all of the group's words, and whether they name its call after the first comma.

    Watches are parameters, few and fixed, so that each title is tested against them in one pass, without a join.
    """
    title = F.substring(F.coalesce("text", F.lit("")), 1, 120)
    t = table(spark, sf_dir, "documents").select("doc_id", fold(title).alias("title"), F.lower(F.regexp_replace(title, "^[^,]*,", "")).alias("body"))
    return t.select("doc_id", F.explode(watched(F.col("title"), F.col("body"), WATCHES)).alias("w")).select("doc_id", "w.watch", "w.relevance")


def watched(title: Column, body: Column, watches: tuple) -> Column:
    """The watches that a title fits, with their relevance; ``body``: what follows the title's first comma."""
    any_of = lambda cs: F.array_contains(F.array(*cs), True)
    all_of = lambda cs: ~F.array_contains(F.array(*cs), False)
    one = lambda name, refs, groups: F.when(any_of([all_of([F.contains(title, F.lit(w)) for w in g]) for g in groups]), F.struct(F.lit(name).alias("watch"), F.when(any_of([F.contains(body, F.lit(r)) for r in refs]), "convocatoria").otherwise("cuerpo").alias("relevance")))
    return F.filter(F.array(*[one(*w) for w in watches]), lambda x: x.isNotNull())


_CITING = "CASE WHEN doc_id % 3 = 0 THEN 'Anuncio BOE-A-2024-' || (doc_id % 50) || ' y BOE-A-2023-' || (doc_id % 9) || '. ' WHEN doc_id % 3 = 1 THEN 'BOE-A-1999-' || doc_id || ' ' ELSE '' END"


@query("cited_merges", f"""WITH d AS (SELECT doc_id, source = 'src1' AS own_gazette, regexp_extract_all({_CITING} || coalesce(text, ''), 'BOE-A-[0-9]{{4}}-[0-9]+') AS ids FROM documents), r AS (SELECT DISTINCT 'BOE-A-2024-' || (o_orderkey % 40) AS id FROM orders UNION SELECT 'BOE-A-2023-4'),
x AS (SELECT doc_id, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM d WHERE NOT coalesce(own_gazette, false)), m AS (SELECT doc_id, arg_min(x.id, pos) AS record FROM x JOIN r ON r.id = x.id GROUP BY doc_id)
SELECT record, count(*) AS n_sources, min(doc_id) AS first_doc FROM m GROUP BY record""")
def cited_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of another source that cites a known record becomes a further source of the first one it cites."""
    d = table(spark, sf_dir, "documents").where("NOT coalesce(source = 'src1', false)").select("doc_id", F.concat(F.expr(_CITING), F.coalesce("text", F.lit(""))).alias("t"))
    records = table(spark, sf_dir, "orders").select(F.concat(F.lit("BOE-A-2024-"), F.col("o_orderkey") % 40).alias("id")).union(spark.createDataFrame([("BOE-A-2023-4",)], "id string")).distinct()
    cited = d.select("doc_id", F.posexplode(F.regexp_extract_all("t", F.lit("(BOE-A-[0-9]{4}-[0-9]+)"), F.lit(1))).alias("pos", "id"))
    first = cited.join(records, "id").groupBy("doc_id").agg(F.min_by("id", "pos").alias("record"))
    return first.groupBy("record").agg(F.count(F.lit(1)).alias("n_sources"), F.min("doc_id").alias("first_doc"))


def in_force(text: Column) -> Column:
    """Whether a section is in force: without lines quoted by >, it doesn't begin with (derogado), (suprimido), (sin contenido) or (sin vigencia)."""
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.ltrim(x).startswith(">")), "\n")
    return ~flat(kept).rlike(r"(?i)^[^a-zA-Z0-9_]*\((derogad|suprimid|sin contenido|sin vigencia)")


_SECTION = "CASE doc_id % 6 WHEN 0 THEN '(Derogado)' WHEN 1 THEN '> nota{nl} «(Sin contenido) ' WHEN 2 THEN '> (Suprimida){nl}Texto ' WHEN 3 THEN 'El (derogado) ' ELSE '' END || substr(coalesce(text, ''), 1, 50)"


@query("sections_in_force", rf"""WITH s AS (SELECT doc_id, {_SECTION.format(nl="' || chr(10) || '")} AS t FROM documents), k AS (SELECT doc_id, array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT starts_with(ltrim(x), '>')), chr(10)) AS t FROM s)
SELECT doc_id, NOT regexp_matches({_FLAT('t')}, '(?i)^[^a-zA-Z0-9_]*\((derogad|suprimid|sin contenido|sin vigencia)') AS in_force FROM k""")
def sections_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sections' own text says that they are in force."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", _SECTION.format(nl="\\n") + " AS t").select("doc_id", in_force(F.col("t")).alias("in_force"))


#: Fields of a call record, and the sources that they are quoted from.
_FIELDS = {"plazas": "substr(text, 1, 20)", "grupo": "CASE WHEN doc_id % 4 = 0 THEN 'no esta' ELSE substr(text, 5, 15) END", "pruebas": "CASE WHEN doc_id % 5 <> 0 THEN substr(text, 30, 12) END", "pruebas2": "CASE WHEN doc_id % 3 = 0 THEN substr(text, 50, 9) END"}


@query("call_records", f"""WITH d AS (SELECT doc_id, {_FLAT('text')} AS t, text FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)), f AS (SELECT doc_id, t, unnest([{', '.join(f"'{k}'" for k in _FIELDS)}]) AS field, unnest([{', '.join(_FIELDS.values())}]) AS quote FROM d),
c AS (SELECT doc_id, replace(field, '2', '') AS field, field AS place, quote, contains(t, {_FLAT('quote')}) AND trim(quote) <> '' AS ok FROM f WHERE quote IS NOT NULL)
SELECT doc_id, field, coalesce(string_agg(CASE WHEN ok THEN {_FLAT('quote')} END, '; ' ORDER BY place), '') AS value, count(*) FILTER (WHERE NOT ok) AS n_discarded FROM c GROUP BY doc_id, field""")
def call_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with their quotes, checked again in the source; several values of one field are joined, those not found are counted out."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = F.create_map(*[x for k, e in _FIELDS.items() for x in (F.lit(k), F.expr(e))])
    f = d.select("doc_id", flat(F.col("text")).alias("t"), F.explode(rows).alias("place", "quote")).where("quote IS NOT NULL")
    f = f.select("doc_id", F.regexp_replace("place", "2", "").alias("field"), "place", flat(F.col("quote")).alias("quote"), (F.contains("t", flat(F.col("quote"))) & (F.trim("quote") != "")).alias("ok"))
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("place", "quote")))), lambda x: x["quote"])
    return f.groupBy("doc_id", "field").agg(F.array_join(kept, "; ").alias("value"), F.count_if(~F.col("ok")).alias("n_discarded"))


_CATALOGUE = {"id": "'o-' || s_suppkey", "category": "CASE WHEN s_suppkey % 9 = 0 THEN 'otra' ELSE 'policia' END", "state": "CASE WHEN s_suppkey % 7 = 0 THEN 'abierta' WHEN s_suppkey % 13 <> 0 THEN 'activa' END", "url": "CASE WHEN s_suppkey % 5 = 0 THEN 'http://x' ELSE 'https://x' END",
              "source": "'Se convocan ' || (s_suppkey * 10) || ' plazas (' || s_suppkey || ') y (' || (9 * s_suppkey) || ') mas'", "value": "CASE WHEN s_suppkey % 11 = 0 THEN s_suppkey ELSE s_suppkey * 10 END", "quote": "CASE WHEN s_suppkey % 8 = 0 THEN 'Se convocan muchas' ELSE 'Se convocan ' || (s_suppkey * 10) || ' plazas' END", "parts": "'(' || s_suppkey || ') y (' || (CASE WHEN s_suppkey % 6 = 0 THEN 8 ELSE 9 END * s_suppkey) || ')'", "lessons": "CASE WHEN s_suppkey % 10 = 0 THEN '1,2,4' ELSE '1,2,3' END"}
_CATALOGUE_SQL = "c AS (SELECT s_suppkey, " + ", ".join(f"{e} AS {n}" for n, e in _CATALOGUE.items()) + " FROM supplier)"


@query("catalogue_validation", f"""WITH {_CATALOGUE_SQL} SELECT s_suppkey, unnest(list_filter([CASE WHEN state IS NULL THEN 'missing state' END, CASE WHEN category NOT IN ('policia') THEN 'unknown category' END, CASE WHEN state NOT IN ('activa', 'proxima', 'cerrada', 'historica') THEN 'unknown state' END, CASE WHEN NOT starts_with(url, 'https://') THEN 'source without https' END,
  CASE WHEN NOT contains(source, quote) THEN 'quote not in the source' END, CASE WHEN NOT contains(quote, value::VARCHAR) THEN 'number not in its quote' END, CASE WHEN list_sum(list_transform(regexp_extract_all(parts, '[0-9]+'), lambda x: x::BIGINT)) <> value THEN 'parts do not add up' END,
  CASE WHEN string_split(lessons, ',') <> list_transform(range(1, len(string_split(lessons, ',')) + 1), lambda i: i::VARCHAR) THEN 'lessons not numbered on' END], lambda x: x IS NOT NULL)) AS finding FROM c""")
def catalogue_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required fields, domains, secure sources, literal quotes, numbers in their quotes, sums of quoted parts, numbering."""
    c = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", *[f"{e} AS {n}" for n, e in _CATALOGUE.items()])
    total = F.aggregate(F.regexp_extract_all("parts", F.lit("([0-9]+)"), F.lit(1)), F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))
    lessons = F.split("lessons", ",")
    rules = [
        (F.col("state").isNull(), "missing state"), (~F.col("category").isin("policia"), "unknown category"), (~F.col("state").isin("activa", "proxima", "cerrada", "historica"), "unknown state"), (~F.col("url").startswith("https://"), "source without https"),
        (~F.contains("source", "quote"), "quote not in the source"), (~F.contains(F.col("quote"), F.col("value").cast("string")), "number not in its quote"), (total != F.col("value"), "parts do not add up"),
        (lessons != F.transform(F.sequence(F.lit(1), F.size(lessons)), lambda i: i.cast("string")), "lessons not numbered on"),
    ]
    return c.select("s_suppkey", F.explode(F.filter(F.array(*[F.when(x, F.lit(n)) for x, n in rules]), lambda x: x.isNotNull())).alias("finding"))


#: Kinds of change that a notice may bring, and the event each becomes.
NOTICES = {"fecha_examen": "EXAM_DATE_CHANGED", "listas": "OFFICIAL_LIST_PUBLISHED", "aprobados": "OFFICIAL_LIST_PUBLISHED", "modificacion": "CONVOCATION_UPDATED", "correccion": "CONVOCATION_UPDATED"}
_PRODUCED = {
    "calls": "SELECT 'NEW_CONVOCATION' AS kind, 'convocatoria' AS entity, '' || o_orderkey AS id, 'NEW_CONVOCATION:' || o_orderkey AS key FROM orders WHERE o_orderstatus = 'P'",
    "updates": "SELECT 'CONVOCATION_UPDATED', 'convocatoria', '' || o_orderkey, 'CONVOCATION_UPDATED:u' || o_orderkey FROM orders WHERE o_orderstatus = 'P' AND starts_with(o_orderpriority, '1')",
    "notices": "SELECT CASE l_linenumber % 6 WHEN 0 THEN 'EXAM_DATE_CHANGED' WHEN 1 THEN 'OFFICIAL_LIST_PUBLISHED' WHEN 2 THEN 'OFFICIAL_LIST_PUBLISHED' ELSE 'CONVOCATION_UPDATED' END, 'oposicion', '' || l_suppkey, CASE l_linenumber % 6 WHEN 0 THEN 'EXAM_DATE_CHANGED' WHEN 1 THEN 'OFFICIAL_LIST_PUBLISHED' WHEN 2 THEN 'OFFICIAL_LIST_PUBLISHED' ELSE 'CONVOCATION_UPDATED' END || ':' || l_suppkey || ':' || l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber % 6 < 5",
    "documents": "SELECT 'OFFICIAL_DOCUMENT_CHANGED', 'documento', '' || doc_id, 'OFFICIAL_DOCUMENT_CHANGED:' || doc_id || ':' || md5(coalesce(text, '')) FROM documents WHERE lang = 'es'",
    "failures": "SELECT 'OFFICIAL_SOURCE_FAILED', 'fuente', '' || s_suppkey, 'OFFICIAL_SOURCE_FAILED:' || s_suppkey FROM supplier WHERE s_acctbal < 0",
    "new": "SELECT 'NEW_OPPOSITION', 'oposicion', '' || n_nationkey, 'NEW_OPPOSITION:' || n_nationkey FROM nation WHERE n_regionkey = 1",
    "syllabus": "SELECT 'SYLLABUS_UPDATED', 'oposicion', '' || n_nationkey, 'SYLLABUS_UPDATED:' || n_nationkey || ':' || md5(n_name) FROM nation WHERE n_regionkey = 2",
    "ticks": "SELECT 'DAILY_TICK', 'calendario', '' || CAST(ts AS DATE), 'DAILY_TICK:' || CAST(ts AS DATE) FROM events",
}
_PRODUCED_SQL = "p AS (SELECT DISTINCT kind, entity, id, key FROM (" + " UNION ALL ".join(_PRODUCED.values()) + "))"


def produced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of eight states, one per idempotency key: kind, entity, id, key.

    A key holds what its event is made of, so rows are made distinct by those columns, as numbers where they are, in each
    state on its own, and keys are made of what is left. Keys of different states differ.
    """
    t = lambda name: table(spark, sf_dir, name)
    lit, col = F.lit, F.col
    once = lambda df, *of: df.select(*of).distinct()
    event = lambda df, kind, entity, id_, *rest: df.select(kind.alias("kind"), F.lit(entity).alias("entity"), id_.cast("string").alias("id"), F.concat_ws(":", kind, *rest).alias("key"))
    place = col("l_linenumber") % 6
    notices = [(place == 0, NOTICES["fecha_examen"]), (place.isin(1, 2), NOTICES["listas"]), (place.isin(3, 4), NOTICES["modificacion"])]
    number = F.coalesce(*[F.when(c, i) for i, (c, _) in enumerate(notices)])
    notice = F.coalesce(*[F.when(col("notice") == i, name) for i, (_, name) in enumerate(notices)])
    calls = t("orders").where("o_orderstatus = 'P'")
    lines = t("lineitem").where("l_returnflag = 'A'").where(place < 5)
    digest = F.md5(F.coalesce("text", lit(""))).alias("digest")
    parts = [
        event(once(calls, "o_orderkey"), lit("NEW_CONVOCATION"), "convocatoria", col("o_orderkey"), "o_orderkey"),
        event(once(calls.where("startswith(o_orderpriority, '1')"), "o_orderkey"), lit("CONVOCATION_UPDATED"), "convocatoria", col("o_orderkey"), F.concat(lit("u"), "o_orderkey")),
        event(once(lines, number.alias("notice"), "l_suppkey", "l_partkey"), notice, "oposicion", col("l_suppkey"), "l_suppkey", "l_partkey"),
        event(once(t("documents").where("lang = 'es'"), "doc_id", digest), lit("OFFICIAL_DOCUMENT_CHANGED"), "documento", col("doc_id"), "doc_id", "digest"),
        event(once(t("supplier").where("s_acctbal < 0"), "s_suppkey"), lit("OFFICIAL_SOURCE_FAILED"), "fuente", col("s_suppkey"), "s_suppkey"),
        event(once(t("nation").where("n_regionkey = 1"), "n_nationkey"), lit("NEW_OPPOSITION"), "oposicion", col("n_nationkey"), "n_nationkey"),
        event(once(t("nation").where("n_regionkey = 2"), "n_nationkey", "n_name"), lit("SYLLABUS_UPDATED"), "oposicion", col("n_nationkey"), "n_nationkey", F.md5("n_name")),
        event(once(t("events"), F.to_date("ts").alias("d")), lit("DAILY_TICK"), "calendario", col("d"), "d"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("event_producers", f"WITH {_PRODUCED_SQL} SELECT kind, entity, count(*) AS n, min(key) AS first_key FROM p GROUP BY ALL")
def event_producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind, from eight states, each published once."""
    return produced(spark, sf_dir).groupBy("kind", "entity").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"))


#: What follows an event in the next pass.
FOLLOWS = {"NEW_CONVOCATION": ("CONTENT_PROPOSED", "ALERT_QUEUED"), "EXAM_DATE_CHANGED": ("ALERT_QUEUED",), "CONTENT_PROPOSED": ("REVIEW_REQUESTED",)}


@query("causal_passes", f"""WITH {_PRODUCED_SQL}, f(cause, kind) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, bs in FOLLOWS.items() for b in bs)}),
one AS (SELECT f.kind, p.key || '>' || f.kind AS key, p.key AS correlation FROM p JOIN f ON f.cause = p.kind), two AS (SELECT f.kind, one.key || '>' || f.kind AS key, correlation FROM one JOIN f ON f.cause = one.kind)
SELECT kind, pass, count(*) AS n, count(DISTINCT correlation) AS n_chains FROM (SELECT kind, 0 AS pass, key AS correlation FROM p UNION ALL SELECT kind, 1, correlation FROM one UNION ALL SELECT kind, 2, correlation FROM two) GROUP BY ALL""")
def causal_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that follow from others keep the key of the first as their correlation, and are taken up one pass later."""
    return passes(produced(spark, sf_dir), FOLLOWS, 2)


def passes(events: DataFrame, follows: dict[str, tuple[str, ...]], n_passes: int) -> DataFrame:
    """Kind, pass, n, n_chains of events, of which each has a key of its own, and of what follows from them.

    What follows depends on the kind alone, so events are counted by kind first, and chains of kinds are walked on the
    counts: ``first`` is the kind that a chain began with, and its events are as many chains, however often they arrive.
    """
    now = events.groupBy("kind").agg(F.count(F.lit(1)).alias("each")).select("kind", F.col("kind").alias("first"), "each", F.col("each").alias("n"))
    out = now.withColumn("pass", F.lit(0))
    causes = F.create_map(*[x for k, v in follows.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    for i in range(1, n_passes + 1):
        now = now.select("first", "each", "n", F.explode(F.try_element_at(causes, "kind")).alias("kind"))
        out = out.unionByName(now.withColumn("pass", F.lit(i)))
    arrived = out.groupBy("kind", "pass", "first", "each").agg(F.sum("n").alias("n"))
    return arrived.groupBy("kind", "pass").agg(F.sum("n").alias("n"), F.sum("each").alias("n_chains"))
