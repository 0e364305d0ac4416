"""Calls and articles on their way out: deadlines, facts, quality gates, relations, batch figures, text and url functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import FOLD_SQL, fold, json_int
from ..registry import query, table
from .items import _FLAT, _LIST, _known, flat
from .laws import _map, _map_sql

#: Number words of deadlines (fixed values).
DAYS = {"uno": 1, "un": 1, "cinco": 5, "diez": 10, "quince": 15, "veinte": 20, "veintiuno": 21, "veintiún": 21, "treinta": 30, "cuarenta": 40}


#: A term of days, and a quote that counts it from the gazette (fixed patterns).
TERM, GAZETTE = r"(?i)(\d+|[a-zúñ]+)\s+d[ií]as\s+(h[aá]biles|naturales)", r"(?i)bolet[ií]n oficial del estado|\bBOE\b"


def deadline_state(today: Column) -> Column:
    """A call's state: historic, upcoming, active, closed or unverified.

    ``published``, ``starts``, ``ends`` (dates, the latter two only if officially verified), ``term`` (such as "veinte
    días hábiles") and ``quote``. Older than 540 days is historic; exact dates decide; else the term counts from
    publication in the gazette, working days with weekends added and a margin of seven days for holidays.
    """
    m = TERM
    amount, kind = F.regexp_extract("term", m, 1), F.regexp_extract("term", m, 2)
    n = F.coalesce(amount.try_cast("int"), _map(DAYS)[F.lower(amount)])
    working = kind.rlike("(?i)h[aá]biles")
    least = F.when(working, n + 2 * F.floor(n / 5)).otherwise(n)
    most = F.when(working, least + 7).otherwise(least)
    gone = F.datediff(today, "published")
    known = F.col("published").isNotNull() & n.isNotNull() & F.coalesce(F.col("quote").rlike(GAZETTE), F.lit(False))
    return (
        F.when(gone > 540, "historica").when(F.col("starts").isNotNull() & F.col("ends").isNotNull(), F.when(today < F.col("starts"), "proxima").when(today <= F.col("ends"), "activa").otherwise("cerrada"))
        .when(~known, "por_verificar").when(gone <= least, "activa").when(gone > most, "cerrada").otherwise("por_verificar")
    )


_CALL = {"published": "CASE WHEN o_orderkey % 17 <> 0 THEN DATE '2024-01-01' - CAST(o_orderkey % 60 * CASE WHEN o_orderkey % 8 = 0 THEN 12 ELSE 1 END AS INT) END", "starts": "CASE WHEN o_orderkey % 5 = 0 THEN DATE '2023-12-20' + CAST(o_orderkey % 30 AS INT) END", "ends": "CASE WHEN o_orderkey % 5 = 0 THEN DATE '2023-12-20' + CAST(o_orderkey % 30 + 5 AS INT) END",
         "term": "CASE o_orderkey % 6 WHEN 0 THEN 'veinte días hábiles' WHEN 1 THEN 'plazo de 15 días naturales' WHEN 2 THEN 'treinta días naturales' WHEN 3 THEN '10 dias habiles' WHEN 4 THEN 'pocos días hábiles' END", "quote": "CASE WHEN o_orderkey % 7 = 0 THEN 'en la web' WHEN o_orderkey % 2 = 0 THEN 'desde el Boletín Oficial del Estado' ELSE 'en el BOE de hoy' END"}


@query("deadline_machine", rf"""WITH c AS (SELECT o_orderkey, {', '.join(f'{e} AS {n}' for n, e in _CALL.items())} FROM orders), m AS (SELECT *, regexp_extract(term, '(?i)(\d+|[a-zúñ]+)\s+d[ií]as\s+(h[aá]biles|naturales)', ['n', 'k']) AS g, date_diff('day', published, DATE '2024-01-01') AS gone FROM c),
n AS (SELECT *, coalesce(try_cast(g.n AS INT), {_map_sql(DAYS)}[lower(g.n)]) AS n, regexp_matches(g.k, '(?i)h[aá]biles') AS working FROM m), l AS (SELECT *, CASE WHEN working THEN n + 2 * (n // 5) ELSE n END AS least FROM n), k AS (SELECT *, CASE WHEN working THEN least + 7 ELSE least END AS most FROM l)
SELECT o_orderkey, CASE WHEN gone > 540 THEN 'historica' WHEN starts IS NOT NULL AND ends IS NOT NULL THEN CASE WHEN DATE '2024-01-01' < starts THEN 'proxima' WHEN DATE '2024-01-01' <= ends THEN 'activa' ELSE 'cerrada' END WHEN published IS NULL OR n IS NULL OR NOT regexp_matches(quote, '(?i)bolet[ií]n oficial del estado|\bBOE\b') THEN 'por_verificar' WHEN gone <= least THEN 'activa' WHEN gone > most THEN 'cerrada' ELSE 'por_verificar' END AS state FROM k""")
def deadline_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of example calls on a given day."""
    c = table(spark, sf_dir, "orders").selectExpr("o_orderkey", *[f"{e} AS {n}" for n, e in _CALL.items()])
    return c.select("o_orderkey", deadline_state(F.lit("2024-01-01").cast("date")).alias("state"))


#: Claims that no text may make (folded), and a channel's length (fixed values).
FORBIDDEN = ("garantiz", "aprobar(a|as)? seguro", "plaza asegurada", "testimonio", "sueldo|salario")
LENGTHS = {"x": 280, "telegram": 900, "articulo": 6000, "cta": 200}


def fact_findings(site: str) -> Column:
    """What is wrong with a ``text`` for a ``channel``, given its ``facts`` and ``official`` url: numbers and links that the facts lack, forbidden claims, length (a link counts 23 on x)."""
    bare = F.regexp_replace("text", r"https?://[^ \n]+", "")
    number = F.lit(r"(\d+(?:[.,]\d+)*)")
    facts = F.regexp_extract_all("facts", number, F.lit(1))
    strange = F.array_except(F.regexp_extract_all(bare, number, F.lit(1)), facts)
    wrong_link = F.exists(F.regexp_extract_all("text", F.lit(r"(https?://[^ \n)]+)"), F.lit(1)), lambda u: ~(u.startswith(site) | F.coalesce(u == F.col("official"), F.lit(False))))
    size = F.when(F.col("channel") == "x", F.char_length(F.regexp_replace("text", r"https?://[^ \n]+", "x" * 23))).otherwise(F.char_length("text"))
    strange = F.filter(strange, lambda n: ~F.array_contains(facts, F.regexp_replace(n, r"\.", "")))
    return _known((F.size(strange) > 0, "number not verified"), (wrong_link, "link not allowed"), *[(fold(F.col("text")).rlike(p), f"forbidden claim: {p}") for p in FORBIDDEN], (size > F.create_map(*[F.lit(x) for kv in LENGTHS.items() for x in kv])[F.col("channel")], "too long"))


_POST = {"text": "substr(coalesce(text, ''), 1, CAST(180 + doc_id % 130 AS INT)) || CASE WHEN doc_id % 4 = 0 THEN ' Son 2.704 plazas' WHEN doc_id % 4 = 1 THEN ' Son 2705 plazas' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ' https://site.test/a' WHEN doc_id % 5 = 1 THEN ' https://bad.test/b' WHEN doc_id % 5 = 2 THEN ' https://official.test/c' ELSE '' END || CASE WHEN doc_id % 9 = 0 THEN ' Te garantizamos el salario' ELSE '' END",
         "facts": "'{{\"plazas\": \"2704 y 2.704\", \"anio\": 2024}}'", "official": "'https://official.test/c'", "channel": "CASE doc_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'telegram' ELSE 'cta' END"}
_POST = {k: v.replace("{{", "{").replace("}}", "}") for k, v in _POST.items()}


@query("channel_fact_check", rf"""WITH p AS (SELECT doc_id, {', '.join(f'{e} AS {n}' for n, e in _POST.items())} FROM documents), f AS (SELECT *, regexp_extract_all(facts, '\d+(?:[.,]\d+)*') AS known FROM p)
SELECT doc_id, unnest({_LIST((r"len(list_filter(regexp_extract_all(regexp_replace(text, 'https?://[^ \n]+', '', 'g'), '\d+(?:[.,]\d+)*'), lambda n: NOT list_contains(known, n) AND NOT list_contains(known, replace(n, '.', '')))) > 0", 'number not verified'), (r"len(list_filter(regexp_extract_all(text, 'https?://[^ \n)]+'), lambda u: NOT starts_with(u, 'https://site.test/') AND u <> official)) > 0", 'link not allowed'),
  *[(f"regexp_matches({FOLD_SQL.format('text')}, '{p}')", f"forbidden claim: {p}") for p in FORBIDDEN], (r"CASE WHEN channel = 'x' THEN length(regexp_replace(text, 'https?://[^ \n]+', repeat('x', 23), 'g')) ELSE length(text) END > CASE channel WHEN 'x' THEN 280 WHEN 'telegram' THEN 900 WHEN 'articulo' THEN 6000 ELSE 200 END", 'too long'))}) AS finding FROM f""")
def channel_fact_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example posts against their facts."""
    p = table(spark, sf_dir, "documents").selectExpr("doc_id", *[f"{e} AS {n}" for n, e in _POST.items()])
    return p.select("doc_id", F.explode(fact_findings("https://site.test/")).alias("finding"))


def value_in_quote(field: Column, value: Column, quote: Column) -> Column:
    """P25: whether a value stands in its quote: a number with or without thousands dots or as a word, a system by its word, a name as it is."""
    q = F.lower(flat(quote))
    n = value.try_cast("long")
    digits = F.regexp_extract_all(q, F.lit(r"(\d+(?:\.\d+)*)"), F.lit(1))
    dotted = F.translate(F.format_number(n, 0), ",", ".")
    word = F.exists(F.split(F.regexp_replace(q, "[^a-zúñ]+", " "), " "), lambda w: F.coalesce(_map(DAYS)[w] == n, F.lit(False)))
    number = F.array_contains(digits, n.cast("string")) | F.array_contains(digits, dotted) | word
    name = F.contains(q, F.split_part(F.lower(flat(value)), F.lit(" ("), F.lit(1)))
    return F.when(field == "plazas", F.coalesce(number, F.lit(False))).when(field == "sistema", q.rlike("concurso|oposici")).otherwise(name)


_VALUE = {"field": "CASE doc_id % 3 WHEN 0 THEN 'plazas' WHEN 1 THEN 'sistema' ELSE 'grupo' END", "value": "CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN '2704' ELSE '15' END ELSE substr(coalesce(text, ''), 1, 9) || ' (nota)' END",
          "quote": "CASE doc_id % 4 WHEN 0 THEN 'Se convocan 2.704 plazas' WHEN 1 THEN 'Son quince plazas por concurso' WHEN 2 THEN 'De 2704 a 15' ELSE 'Apartado 2.2704 y 15.1 ' END || substr(coalesce(text, ''), 1, CAST(6 + doc_id % 9 AS INT))"}


@query("values_in_quotes", rf"""WITH v AS (SELECT doc_id, {', '.join(f'{e} AS {n}' for n, e in _VALUE.items())} FROM documents), q AS (SELECT *, lower({_FLAT('quote')}) AS q, try_cast(value AS BIGINT) AS n FROM v)
SELECT doc_id, CASE field WHEN 'plazas' THEN coalesce(list_contains(regexp_extract_all(q, '\d+(?:\.\d+)*'), n::VARCHAR) OR list_contains(regexp_extract_all(q, '\d+(?:\.\d+)*'), replace(format('{{:,}}', n), ',', '.')) OR len(list_filter(string_split(regexp_replace(q, '[^a-zúñ]+', ' ', 'g'), ' '), lambda w: {_map_sql(DAYS)}[w] = n)) > 0, false)
  WHEN 'sistema' THEN regexp_matches(q, 'concurso|oposici') ELSE contains(q, split_part(lower({_FLAT('value')}), ' (', 1)) END AS holds FROM q""")
def values_in_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: example values against their quotes."""
    v = table(spark, sf_dir, "documents").selectExpr("doc_id", *[f"{e} AS {n}" for n, e in _VALUE.items()])
    return v.select("doc_id", value_in_quote(F.col("field"), F.col("value"), F.col("quote")).alias("holds"))


_ARTICLE = {"body": "substr(coalesce(text, ''), 1, CAST(300 + doc_id % 700 AS INT)) || CASE WHEN doc_id % 3 <> 0 THEN ' https://official.test/c' ELSE '' END || CASE WHEN doc_id % 5 <> 0 THEN ' https://site.test/x' ELSE '' END", "status": "CASE WHEN doc_id % 7 = 0 THEN 'OFFICIAL_PENDING_REVIEW' ELSE 'OFFICIAL_VERIFIED' END", "fact": "md5(substr(coalesce(text, ''), 1, 60))", "fields": "doc_id % 5"}


@query("article_gate", f"""WITH a AS (SELECT doc_id, {', '.join(f'{e} AS {n}' for n, e in _ARTICLE.items())} FROM documents), c AS (SELECT *, count(*) OVER (PARTITION BY fact) AS same FROM a)
SELECT doc_id, array_to_string({_LIST(("len(regexp_extract_all(body, '[A-Za-z0-9_]+')) < 90", 'too short'), ("NOT contains(body, 'https://official.test/c')", 'no official source'), ("NOT contains(body, 'https://site.test/')", 'no way on'), ("status <> 'OFFICIAL_VERIFIED'", 'not verified'), ('same > 1', 'duplicate'), ('fields < 2', 'few useful fields'))}, '; ') AS problems FROM c""")
def article_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps an article from being indexed: words, source, way on, state, another article of the same fact, useful fields."""
    a = table(spark, sf_dir, "documents").selectExpr("doc_id", *[f"{e} AS {n}" for n, e in _ARTICLE.items()])
    a = a.join(a.groupBy("fact").agg(F.count(F.lit(1)).alias("same")), "fact")
    n_words = F.size(F.regexp_extract_all("body", F.lit("([A-Za-z0-9_]+)"), F.lit(1)))
    found = _known((n_words < 90, "too short"), (~F.col("body").contains("https://official.test/c"), "no official source"), (~F.col("body").contains("https://site.test/"), "no way on"), (F.col("status") != "OFFICIAL_VERIFIED", "not verified"), (F.col("same") > 1, "duplicate"), (F.col("fields") < 2, "few useful fields"))
    return a.select("doc_id", F.array_join(found, "; ").alias("problems"))


#: What a new call's title says, and what says that it isn't one (fixed patterns).
NEW_CALL = r"(?i)\bse convoca|\bconvocan\b|por la que se convoca|proceso selectivo para (el )?ingreso"
NO_NEW_CALL = "(?i)correcci[oó]n de errores|se modifica|admitid|excluid|aprobad|superado|relaci[oó]n de aspirantes|convocad[oa] por|se nombra|nombramiento|fecha|lugar de celebraci|tribunal"
_TITLED = "CASE doc_id % 7 WHEN 0 THEN 'Resolución por la que se convoca proceso selectivo para ingreso' WHEN 1 THEN 'Se convocan plazas: corrección de errores' WHEN 2 THEN 'Relación de admitidos' WHEN 3 THEN 'Se convoca el cuerpo' ELSE 'Otra cosa del cuerpo' END"


@query("call_relations", rf"""WITH t AS (SELECT doc_id, {_TITLED} AS title, doc_id % 13 = 0 AS own FROM documents)
SELECT doc_id, CASE WHEN own THEN 'misma_convocatoria' WHEN regexp_matches(title, '(?i)\bse convoca|\bconvocan\b|por la que se convoca|proceso selectivo para (el )?ingreso') AND NOT regexp_matches(title, '(?i)correcci[oó]n de errores|se modifica|admitid|excluid|aprobad|superado|relaci[oó]n de aspirantes|convocad[oa] por|se nombra|nombramiento|fecha|lugar de celebraci|tribunal') THEN 'nueva_convocatoria' ELSE 'mismo_cuerpo' END AS relation FROM t WHERE own OR contains(lower(title), 'cuerpo') OR (contains(lower(title), 'convoca') AND contains(lower(title), 'se '))""")
def call_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A publication that a body's watch fits is its own call, a new call or news of the same body."""
    t = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_TITLED} AS title").withColumn("own", F.col("doc_id") % 13 == 0)
    low = F.lower("title")
    fits = low.contains("cuerpo") | (low.contains("convoca") & low.contains("se "))
    new = F.col("title").rlike(NEW_CALL) & ~F.col("title").rlike(NO_NEW_CALL)
    return t.where(F.col("own") | fits).select("doc_id", F.when(F.col("own"), "misma_convocatoria").when(new, "nueva_convocatoria").otherwise("mismo_cuerpo").alias("relation"))


@query("batch_metrics", """WITH b AS (SELECT l_suppkey % 40 AS batch, count(*) AS made, count(*) FILTER (WHERE l_returnflag = 'N') AS valid, count(*) FILTER (WHERE l_returnflag = 'A') AS review, count(*) FILTER (WHERE l_returnflag = 'R') AS rejected, count(*) FILTER (WHERE l_quantity > 45) AS duplicate, count(*) FILTER (WHERE l_linenumber = 7 AND l_tax > 0.07) AS major, sum(l_quantity::BIGINT * 1000)::BIGINT AS tokens FROM lineitem GROUP BY 1),
r AS (SELECT *, round(100.0 * valid / made, 1) AS valid_rate, round(100.0 * review / made, 1) AS review_rate, round(100.0 * rejected / made, 1) AS reject_rate, round(100.0 * duplicate / made, 1) AS duplicate_rate FROM b)
SELECT batch, made, valid_rate, review_rate, reject_rate, duplicate_rate, round(tokens * 3.0 / 1000000, 4) AS cost, array_to_string(list_filter([CASE WHEN valid = made THEN 'all valid' END, CASE WHEN major > 5 THEN 'audit finds errors' END, CASE WHEN duplicate_rate > 10 THEN 'duplicates' END, CASE WHEN reject_rate > 25 THEN 'rejections' END, CASE WHEN review_rate > 26 THEN 'reviews' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r""")
def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18, A23, A25, A28, cost functions: a batch's rates with one decimal, its cost by tokens and price, and the reasons to pause."""
    n = lambda c: F.count_if(c)
    flag = F.col("l_returnflag")
    b = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("batch")).agg(F.count(F.lit(1)).alias("made"), n(flag == "N").alias("valid"), n(flag == "A").alias("review"), n(flag == "R").alias("rejected"), n(F.col("l_quantity") > 45).alias("duplicate"), n((F.col("l_linenumber") == 7) & (F.col("l_tax") > 0.07)).alias("major"), F.sum(F.col("l_quantity").cast("long") * 1000).alias("tokens"))
    rate = lambda c: F.round(100.0 * F.col(c).cast("double") / F.col("made"), 1)
    r = b.withColumns({f"{name}_rate": rate(c) for name, c in (("valid", "valid"), ("review", "review"), ("reject", "rejected"), ("duplicate", "duplicate"))})
    reasons = _known((F.col("valid") == F.col("made"), "all valid"), (F.col("major") > 5, "audit finds errors"), (F.col("duplicate_rate") > 10, "duplicates"), (F.col("reject_rate") > 25, "rejections"), (F.col("review_rate") > 26, "reviews"))
    return r.select("batch", "made", "valid_rate", "review_rate", "reject_rate", "duplicate_rate", F.round(F.col("tokens") * 3.0 / 1_000_000, 4).alias("cost"), F.array_join(reasons, ",").alias("reasons"))


#: Signs in a text of the kinds of question that it bears (fixed values, without marks).
SIGNS = {"plazos": r"\b(dias?|mes(es)?|anos?|horas?|plazo|semanas?)\b", "competencias": r"\b(corresponde|compete|competencia|atribu|facultad)", "requisitos": r"\b(requisito|debera|sera necesario|podran|exig|condicion)", "excepcion": r"\b(salvo|excepto|no obstante|sin perjuicio|excepcion|en ningun caso|unicamente|solo podr)"}
ALWAYS = ("literal", "conceptual", "aplicacion", "negativa", "dificil", "caso_practico")
_ARTICLE_TEXT = "CASE doc_id % 5 WHEN 0 THEN 'El plazo de los articulos 23 y artículo 4 bis será de diez días, salvo el artículo 96 de la Constitución. ' WHEN 1 THEN 'Corresponde al organo; debera cumplir el articulo 12 y el artículo 12. ' WHEN 2 THEN '(Derogado) ' ELSE '' END || substr(coalesce(text, ''), 1, CAST(100 + 5 * (doc_id % 90) AS INT))"


@query("article_capacity", rf"""WITH a AS (SELECT doc_id, {_ARTICLE_TEXT} AS t FROM documents), s AS (SELECT *, {FOLD_SQL.format('t')} AS f, len(list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')) AS n FROM a)
SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)^[^a-zA-Z0-9_]*\((derogad|suprimid|sin contenido|sin vigencia)') OR n < 20 THEN 0 ELSE greatest(1, least(8, n // 15)) END::INTEGER AS capacity, array_to_string(list_concat([{', '.join(repr(x) for x in ALWAYS)}], {_LIST(*[(f"regexp_matches(f, '{p}')", k) for k, p in SIGNS.items()])}), ',') AS kinds,
  array_to_string(list_filter(list_transform(regexp_extract_all(f, 'articulos?\s+(\d+(?:\s?(?:bis|ter|quater))?(?: de la constituci)?)', 1), lambda x: replace(x, ' ', '')), lambda x: NOT contains(x, 'constituci')), ',') AS cites FROM s""")
def article_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many questions an article bears by its length, the kinds that its words allow, and the articles of its own law that it cites."""
    a = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_ARTICLE_TEXT} AS t").withColumn("f", fold(F.col("t"))).withColumn("n", F.size(F.filter(F.split("t", r"\s+"), lambda w: w != "")))
    dead = F.col("t").rlike(r"(?i)^[^a-zA-Z0-9_]*\((derogad|suprimid|sin contenido|sin vigencia)") | (F.col("n") < 20)
    kinds = F.concat(F.array(*map(F.lit, ALWAYS)), _known(*[(F.col("f").rlike(p), k) for k, p in SIGNS.items()]))
    cites = F.regexp_extract_all("f", F.lit(r"articulos?\s+(\d+(?:\s?(?:bis|ter|quater))?(?: de la constituci)?)"), F.lit(1))
    cites = F.filter(F.transform(cites, lambda x: F.regexp_replace(x, " ", "")), lambda x: ~x.contains("constituci"))
    return a.select("doc_id", F.when(dead, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(8), F.floor(F.col("n") / 15)))).cast("int").alias("capacity"), F.array_join(kinds, ",").alias("kinds"), F.array_join(cites, ",").alias("cites"))


def slug(text: Column) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-|-$", ""), F.lit(80))


def cut_at_word(text: Column, n: int) -> Column:
    """A text of ``n`` characters at most, cut between words, without signs or small words at its end."""
    t = flat(text)
    whole = F.regexp_extract(F.left(t, F.lit(n + 1)), r"^(.*) [^ ]*$", 1)
    for _ in range(4):
        whole = F.regexp_replace(F.regexp_replace(whole, r"[ ,;:.(/-]+$", ""), r" +(de|del|la|las|el|los|y|e|o|u|en|a|al|con|por|para|sus?|un|una|que|se)$", "")
    return F.when(F.char_length(t) <= n, t).otherwise(whole)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC by its definition, from SHA-256 over bytes; ``key`` has 64 bytes at most."""
    pad = lambda byte: bytes(k ^ byte for k in key.ljust(64, b"\0"))
    inner = F.unhex(F.sha2(F.concat(F.lit(pad(0x36)), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(pad(0x5C)), inner), 256)


_CUT_SQL = f"CASE WHEN length(t) <= 40 THEN t ELSE {{}} END"


def _trimmed_sql(x: str) -> str:
    for _ in range(4):
        x = rf"regexp_replace(regexp_replace({x}, '[ ,;:.(/-]+$', ''), ' +(de|del|la|las|el|los|y|e|o|u|en|a|al|con|por|para|sus?|un|una|que|se)$', '')"
    return x


@query("text_functions", rf"""WITH d AS (SELECT doc_id, {_FLAT("coalesce(text, '')")} AS t, coalesce(source, '') AS source FROM documents)
SELECT doc_id, left(regexp_replace(regexp_replace({FOLD_SQL.format('t')}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 80) AS slug, {_CUT_SQL.format(_trimmed_sql("regexp_extract(left(t, 41), '^(.*) [^ ]*$', 1)"))} AS title, len(list_filter(string_split(t, '. '), lambda s: length(s) BETWEEN 15 AND 700))::INTEGER AS n_sentences,
  'https://site.test/x?utm_source=' || source || '&utm_medium=' || CASE WHEN doc_id % 2 = 0 THEN 'email' ELSE 'social' END || '&utm_campaign=c' || (doc_id % 9) || '&utm_content=' || doc_id AS link, replace(format('{{:,}}', doc_id * 977), ',', '.') AS thousands, strftime(DATE '2024-01-01' + (doc_id % 366)::INTEGER, '%d/%m/%Y') AS day,
  substr(sha256('{{"id":' || doc_id || ',"source":"' || source || '"}}'), 1, 16) AS fingerprint, substr(sha1(source), 1, 16) AS short FROM d""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String, URL, conversion and hash functions: slugs, titles cut at a word, sentences, campaign links, thousands, days, digests of canonical JSON."""
    d = table(spark, sf_dir, "documents").select("doc_id", flat(F.coalesce("text", F.lit(""))).alias("t"), F.coalesce("source", F.lit("")).alias("source"))
    link = F.concat(F.lit("https://site.test/x?utm_source="), "source", F.lit("&utm_medium="), F.when(F.col("doc_id") % 2 == 0, "email").otherwise("social"), F.lit("&utm_campaign=c"), F.col("doc_id") % 9, F.lit("&utm_content="), "doc_id")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 366).cast("int")), "dd/MM/yyyy")
    sentences = F.size(F.filter(F.split("t", r"\. "), lambda s: F.char_length(s).between(15, 700)))
    return d.select("doc_id", slug(F.col("t")).alias("slug"), cut_at_word(F.col("t"), 40).alias("title"), sentences.alias("n_sentences"), link.alias("link"), F.translate(F.format_number(F.col("doc_id") * 977, 0), ",", ".").alias("thousands"), day.alias("day"), F.left(F.sha2(F.to_json(F.struct(F.col("doc_id").alias("id"), "source")), 256), F.lit(16)).alias("fingerprint"), F.left(F.sha1("source"), F.lit(16)).alias("short"))


@query("webhook_events", "WITH w AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'subscription_created' WHEN 'O' THEN 'subscription_payment_success' ELSE 'subscription_cancelled' END AS name, floor(o_totalprice)::BIGINT AS total, o_orderdate AS ts FROM orders), p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, name = 'subscription_payment_success' ORDER BY ts, o_orderkey) AS n FROM w)\nSELECT o_orderkey, CASE name WHEN 'subscription_created' THEN 'active' WHEN 'subscription_payment_success' THEN 'active' ELSE 'cancelled' END AS state, CASE WHEN name = 'subscription_payment_success' THEN floor(total * 20 / 100 + 0.5)::BIGINT END AS commission, name = 'subscription_payment_success' AND n = 1 AS converts FROM p")
def webhook_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment events to states, the commission of a payment, and a user's first charge, which converts their referral."""
    status = F.col("o_orderstatus")
    w = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(status == "F", "subscription_created").when(status == "O", "subscription_payment_success").otherwise("subscription_cancelled").alias("name"), F.floor("o_totalprice").alias("total"), F.col("o_orderdate").alias("ts"))
    paid = F.col("name") == "subscription_payment_success"
    first = w.where(paid).groupBy("o_custkey").agg(F.min(F.struct("ts", "o_orderkey"))["o_orderkey"].alias("first_key"))
    state = F.when(F.col("name") == "subscription_cancelled", "cancelled").otherwise("active")
    return w.join(first, "o_custkey", "left").select("o_orderkey", state.alias("state"), F.when(paid, F.floor(F.col("total") * 20 / 100 + 0.5)).alias("commission"), (paid & F.coalesce(F.col("o_orderkey") == F.col("first_key"), F.lit(False))).alias("converts"))


@query("provenance", "WITH c AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'card-' || s_suppkey END AS url, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE DATE '2024-01-01' + s_suppkey::INTEGER END AS published, CASE WHEN s_suppkey % 5 = 0 THEN DATE '2024-03-01' END AS checked FROM supplier), r AS (SELECT s_suppkey AS id, 'reg-' || s_suppkey AS url, DATE '2023-06-01' AS published FROM supplier WHERE s_nationkey < 15)\nSELECT s_suppkey, coalesce(c.url, r.url) AS url, coalesce(c.published, r.published) AS published, greatest(c.published, c.checked, r.published) AS last_change, CASE WHEN c.url IS NOT NULL THEN 'OFFICIAL_VERIFIED' WHEN r.url IS NOT NULL THEN 'OFFICIAL_REGISTERED' ELSE 'NO_SOURCE' END AS status FROM c LEFT JOIN r ON id = s_suppkey")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card's fields or else the registry's, the latest change of several sources without blanks, the status by what is there."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    day = lambda text: F.lit(text).cast("date")
    c = s.select("s_suppkey", F.when(k % 3 != 0, F.concat(F.lit("card-"), k)).alias("url"), F.when(k % 4 != 0, F.date_add(day("2024-01-01"), k.cast("int"))).alias("published"), F.when(k % 5 == 0, day("2024-03-01")).alias("checked"))
    r = s.where("s_nationkey < 15").select("s_suppkey", F.concat(F.lit("reg-"), k).alias("r_url"), day("2023-06-01").alias("r_published"))
    status = F.when(F.col("url").isNotNull(), "OFFICIAL_VERIFIED").when(F.col("r_url").isNotNull(), "OFFICIAL_REGISTERED").otherwise("NO_SOURCE")
    return c.join(r, "s_suppkey", "left").select("s_suppkey", F.coalesce("url", "r_url").alias("url"), F.coalesce("published", "r_published").alias("published"), F.greatest("published", "checked", "r_published").alias("last_change"), status.alias("status"))


@query("block_verification", "WITH q AS (SELECT item_id, text, [substr(text, 1, 20), substr(text, 10, 15), CASE WHEN item_id % 3 = 0 THEN 'no esta' ELSE substr(text, 30, 10) END] AS quotes FROM benchmark) SELECT item_id, len(list_filter(quotes, lambda x: NOT contains(text, x))) = 0 AS verified, array_to_string(list_filter(quotes, lambda x: NOT contains(text, x)), '|') AS missing FROM q")
def block_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block is verified if all its quotes are in the text; else those missing."""
    quotes = F.array(F.substring("text", 1, 20), F.substring("text", 10, 15), F.when(F.col("item_id") % 3 == 0, "no esta").otherwise(F.substring("text", 30, 10)))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.filter(quotes, lambda x: ~F.contains(F.col("text"), x)).alias("missing"))
    return b.select("item_id", (F.size("missing") == 0).alias("verified"), F.array_join("missing", "|").alias("missing"))


@query("milestones", "SELECT o_custkey, o_orderkey, date_diff('day', DATE '1995-06-01', o_orderdate::DATE)::INTEGER AS days_left FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderdate::DATE >= DATE '1995-06-01') WHERE r <= 3")
def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next three dates from a day on, with the days left."""
    day = F.lit("1995-06-01").cast("date")
    o = table(spark, sf_dir, "orders").where(F.to_date("o_orderdate") >= day)
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey", F.datediff(F.to_date("o_orderdate"), day).alias("days_left"))


@query("positional_ids", "WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents WHERE source IS NOT NULL), m AS (SELECT source, count(*) - 1 - length(source) % 3 AS frozen FROM n GROUP BY source) SELECT doc_id, n.source || '-' || i AS id, i <= frozen AS frozen FROM n JOIN m ON m.source = n.source")
def positional_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by place within a source, and whether the manifest has frozen them; numbering is by ranges."""
    from ..tables import number_rows

    d = number_rows(table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source", "doc_id"), ["source", "doc_id"])
    m = d.groupBy("source").agg(F.min("row_number").alias("first"), F.count(F.lit(1)).alias("n"))
    i = F.col("row_number") - F.col("first")
    return d.join(m, "source").select("doc_id", F.concat_ws("-", "source", i.cast("string")).alias("id"), (i <= F.col("n") - 1 - F.char_length("source") % 3).alias("frozen"))


@query("best_marks", "WITH m AS (SELECT user_id, CAST(props->>'$.k' AS BIGINT) % 4 AS test, value, ts, event_id FROM events WHERE event_type = 'purchase') SELECT user_id, test, round(CASE WHEN test < 2 THEN min(value) ELSE max(value) END, 4) AS best, round(arg_max(value, (ts, event_id)), 4) AS latest, count(*) AS n FROM m GROUP BY user_id, test")
def best_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best mark, the least where less is better, and the latest."""
    m = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", (json_int(F.col("props"), "$.k") % 4).alias("test"), "value", "ts", "event_id")
    return m.groupBy("user_id", "test").agg(F.round(F.when(F.col("test") < 2, F.min("value")).otherwise(F.max("value")), 4).alias("best"), F.round(F.max_by("value", F.struct("ts", "event_id")), 4).alias("latest"), F.count(F.lit(1)).alias("n"))


@query("error_groups", "WITH e AS (SELECT user_id, unnest([CAST(props->>'$.k' AS BIGINT) % 5, 10 + CAST(props->>'$.k' AS BIGINT) % 3]) AS topic, event_type = 'error' AS wrong FROM events WHERE event_type IN ('click', 'error')) SELECT topic, count(*) FILTER (WHERE wrong) AS wrong, count(*) AS total, row_number() OVER (ORDER BY count(*) FILTER (WHERE wrong) * 1.0 / count(*) DESC, topic) AS place FROM e GROUP BY topic")
def error_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong answers and all by topic, an answer counting for each of its topics, the weakest first."""
    k = json_int(F.col("props"), "$.k")
    e = table(spark, sf_dir, "events").where("event_type IN ('click', 'error')").select(F.explode(F.array(k % 5, 10 + k % 3)).alias("topic"), (F.col("event_type") == "error").alias("wrong"))
    g = e.groupBy("topic").agg(F.count_if("wrong").alias("wrong"), F.count(F.lit(1)).alias("total"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.col("wrong") / F.col("total")), "topic")).cast("long"))  # one row per topic


@query("ready_queue", "WITH j AS (SELECT event_id, ts, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 4 END AS priority, CAST(props->>'$.k' AS BIGINT) % 6 AS attempts FROM events) SELECT event_id, priority, attempts, row_number() OVER (ORDER BY priority, ts, event_id) AS place FROM (SELECT * FROM j WHERE attempts < 5 ORDER BY priority, ts, event_id LIMIT 200)")
def ready_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next batch of two hundred jobs that have tries left, by priority and age."""
    priority = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).otherwise(4)
    j = table(spark, sf_dir, "events").select("event_id", "ts", priority.alias("priority"), (json_int(F.col("props"), "$.k") % 6).alias("attempts")).where("attempts < 5")
    batch = j.orderBy("priority", "ts", "event_id").limit(200)
    return batch.select("event_id", "priority", "attempts", F.row_number().over(Window.orderBy("priority", "ts", "event_id")).cast("long").alias("place"))


@query("source_backoff", "WITH s AS (SELECT s_suppkey, s_suppkey % 9 AS failures, CASE WHEN s_suppkey % 2 = 0 THEN 24 ELSE 6 END AS every FROM supplier) SELECT s_suppkey, CASE WHEN failures = 0 THEN every ELSE least(every, (2 ** (failures - 1)))::INTEGER END AS wait_hours FROM s")
def source_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wait after failures in a row, doubled each time and at most the source's own interval."""
    k = F.col("s_suppkey")
    every = F.when(k % 2 == 0, 24).otherwise(6)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 9 == 0, every).otherwise(F.least(every, F.pow(F.lit(2.0), k % 9 - 1).cast("int"))).alias("wait_hours"))


@query("public_split", "SELECT p_partkey, p_brand, r <= 3 AS public FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part)")
def public_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of each group are public; only those are ranked, the others keep their place."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    first = p.withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))).where("r <= 3").select("p_partkey", F.lit(True).alias("public"))
    return p.join(first, "p_partkey", "left").select("p_partkey", "p_brand", F.coalesce("public", F.lit(False)).alias("public"))


@query("year_index", "SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n, arg_max(o_orderkey, (o_orderdate, -o_orderkey)) AS latest FROM orders GROUP BY 1")
def year_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct years of a list, how many items each has, the latest with ties to the smaller id."""
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.max_by("o_orderkey", F.struct("o_orderdate", (-F.col("o_orderkey")).alias("m"))).alias("latest"))


@query("main_links", r"""WITH m AS (SELECT page_id, regexp_extract(html, '(?s)<(?:main|article)[^>]*>(.*?)</(?:main|article)>', 1) AS m FROM pages), n AS (SELECT page_id, regexp_extract(regexp_replace(html, '(?s)</?(?:main|article)[^>]*>', ''), '(?s)<nav>(.*?)</nav>', 1) AS nav, m FROM pages JOIN m USING (page_id)), t AS (SELECT page_id, regexp_replace(nav || m, '(?s)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', '\2 [\1] ', 'g') AS t FROM n)
SELECT page_id, md5(trim(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5, nullif(regexp_extract(t, '\[(/[^\]]*)\]', 1), '') AS first_link FROM t""")
def main_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The menu's and the main element's text with its links as ``text [url]``, and the first link."""
    part = lambda p: F.regexp_extract("html", p, 1)
    t = F.concat(part(r"(?s)<nav>(.*?)</nav>"), part(r"(?s)<(?:main|article)[^>]*>(.*?)</(?:main|article)>"))
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(t, r'(?s)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', "$2 [$1] ").alias("t"))
    first = F.nullif(F.regexp_extract("t", r"\[(/[^\]]*)\]", 1), F.lit(""))
    return p.select("page_id", F.md5(F.trim(F.regexp_replace(F.regexp_replace("t", "<[^>]*>", " "), r"\s+", " "))).alias("text_md5"), first.alias("first_link"))


@query("progress_union", "WITH a AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_id % 2 = 0 THEN 'phone' ELSE 'desk' END AS device FROM events), c AS (SELECT device, user_id, count(*) FILTER (WHERE event_type = 'click') AS ok, max(ts) AS last_ts FROM a GROUP BY ALL) SELECT c.user_id, max(ok) AS ok, max(last_ts) AS last_ts, (SELECT count(DISTINCT ts::DATE) FROM a WHERE a.user_id = c.user_id) AS n_days, (SELECT count(DISTINCT event_id) FROM a WHERE a.user_id = c.user_id AND event_type = 'signup') AS n_sessions FROM c GROUP BY c.user_id")
def progress_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two devices' progress as one: larger counters, the newest time, the union of days, sessions without repeats."""
    a = table(spark, sf_dir, "events").withColumn("device", F.when(F.col("event_id") % 2 == 0, "phone").otherwise("desk"))
    each = a.groupBy("device", "user_id").agg(F.count_if(F.col("event_type") == "click").alias("ok"), F.max("ts").alias("last_ts"), F.collect_set(F.to_date("ts")).alias("days"), F.collect_set(F.when(F.col("event_type") == "signup", F.col("event_id"))).alias("sessions"))  # a learner's days and sessions
    size = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    return each.groupBy("user_id").agg(F.max("ok").alias("ok"), F.max("last_ts").alias("last_ts"), size("days").alias("n_days"), size("sessions").alias("n_sessions"))


@query("composite_report", "WITH s AS (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT l_suppkey % 8 AS topic, count(DISTINCT l_partkey) / 2000.0 AS share FROM lineitem GROUP BY 1) SELECT (SELECT to_json(map_from_entries(list((status, n) ORDER BY status)))::VARCHAR FROM s) AS statuses, (SELECT round(100 * avg(least(share, 1)), 4) FROM f) AS covered, (SELECT count(*) FROM s) AS n_statuses")
def composite_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document from several aggregates: counts by status as JSON, the mean of the topics' covered shares."""
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey") % 8).agg((F.countDistinct("l_partkey") / 2000.0).alias("share"))
    left = s.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n"))))).alias("statuses"), F.count(F.lit(1)).alias("n_statuses"))
    right = f.agg(F.round(100 * F.avg(F.least("share", F.lit(1.0))), 4).alias("covered"))
    return left.withColumn("_k", F.lit(1)).join(right.withColumn("_k", F.lit(1)), "_k").select("statuses", "covered", "n_statuses")  # one row each


@query("validity_sweep", "WITH q AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'OUTDATED' WHEN 1 THEN 'REVIEW_REQUIRED' ELSE 'VALID' END AS status, substr(coalesce(text, ''), 1, 40) AS quote, CASE WHEN doc_id % 3 = 0 THEN replace(coalesce(text, ''), 'e', 'E') ELSE coalesce(text, '') END AS now, md5(CASE WHEN doc_id % 3 = 0 THEN replace(coalesce(text, ''), 'e', 'E') ELSE coalesce(text, '') END) AS version, CASE WHEN doc_id % 5 <> 0 THEN md5(coalesce(text, '')) END AS stamp FROM documents)\nSELECT doc_id, CASE WHEN NOT contains(now, quote) THEN 'OUTDATED' WHEN status = 'OUTDATED' THEN 'REVIEW_REQUIRED' ELSE status END AS status, coalesce(stamp, version) AS stamp, stamp IS NULL AS stamped FROM q")
def validity_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item whose quote is gone is outdated, one whose quote is back is to be reviewed; an item without a stamp takes the source's version, once."""
    t = F.coalesce("text", F.lit(""))
    i = F.col("doc_id")
    now = F.when(i % 3 == 0, F.replace(t, F.lit("e"), F.lit("E"))).otherwise(t)
    q = table(spark, sf_dir, "documents").select("doc_id", F.when(i % 4 == 0, "OUTDATED").when(i % 4 == 1, "REVIEW_REQUIRED").otherwise("VALID").alias("status"), F.substring(t, 1, 40).alias("quote"), now.alias("now"), F.when(i % 5 != 0, F.md5(t)).alias("stamp"))
    status = F.when(~F.contains("now", "quote"), "OUTDATED").when(F.col("status") == "OUTDATED", "REVIEW_REQUIRED").otherwise(F.col("status"))
    return q.select("doc_id", status.alias("status"), F.coalesce("stamp", F.md5("now")).alias("stamp"), F.col("stamp").isNull().alias("stamped"))
