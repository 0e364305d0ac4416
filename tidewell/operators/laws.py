"""Parsers of official texts: laws in Markdown, numbers in words, article numbers, dated blocks, dates, gazettes, references."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, table

#: Suffixes of inserted articles, in order (fixed values).
LATIN = "bis|ter|quater|quinquies|sexies|septies|octies|nonies|decies"
#: Number words (fixed values): cardinals, which add up; ordinals, alone or after tens.
CARDINALS = {
    "uno": 1, "una": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10, "once": 11, "doce": 12, "trece": 13, "catorce": 14, "quince": 15, "dieciséis": 16, "dieciseis": 16,
    "diecisiete": 17, "dieciocho": 18, "diecinueve": 19, "veinte": 20, "veintiuno": 21, "veintiún": 21, "veintidós": 22, "veintidos": 22, "veintitrés": 23, "veintitres": 23, "veinticuatro": 24, "veinticinco": 25, "veintiséis": 26,
    "veintiseis": 26, "veintisiete": 27, "veintiocho": 28, "veintinueve": 29, "treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "setenta": 70, "ochenta": 80, "noventa": 90, "cien": 100, "ciento": 100,
}
ORDINALS = {
    "primero": 1, "segundo": 2, "tercero": 3, "cuarto": 4, "quinto": 5, "sexto": 6, "séptimo": 7, "septimo": 7, "octavo": 8, "noveno": 9, "décimo": 10, "decimo": 10, "undécimo": 11, "duodécimo": 12, "decimotercero": 13,
    "decimocuarto": 14, "decimoquinto": 15, "decimosexto": 16, "decimoséptimo": 17, "decimoctavo": 18, "decimonoveno": 19, "vigésimo": 20,
}
TENS = {"vigésimo": 20, "trigésimo": 30, "cuadragésimo": 40, "quincuagésimo": 50, "sexagésimo": 60, "septuagésimo": 70, "octogésimo": 80, "nonagésimo": 90, "centésimo": 100}
#: Months of the second language (fixed values).
MONTHS = {"gener": 1, "febrer": 2, "març": 3, "abril": 4, "maig": 5, "juny": 6, "juliol": 7, "agost": 8, "setembre": 9, "octubre": 10, "novembre": 11, "desembre": 12}


def _map(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def number_of(words: Column) -> Column:
    """The number that cardinal or ordinal words name, or null."""
    parts = F.filter(F.split(F.trim(F.lower(words)), " +"), lambda w: w != "")
    cardinal = F.filter(parts, lambda w: w != "y")
    known, ordinal = _map(CARDINALS), _map({**ORDINALS, **TENS})
    total = lambda arr, m: F.aggregate(arr, F.lit(0), lambda acc, w: acc + m[w])
    all_in = lambda arr, m: (F.size(arr) > 0) & F.forall(arr, lambda w: m[w].isNotNull())
    return F.when(all_in(cardinal, known), total(cardinal, known)).when(all_in(parts, ordinal), total(parts, ordinal))


def _map_sql(values: dict[str, int]) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v}" for k, v in values.items()) + "}"


_NUMBER_SQL = lambda x: f"""CASE WHEN len(list_filter(string_split(lower({x}), ' '), lambda w: w NOT IN ('y', ''))) > 0 AND len(list_filter(string_split(lower({x}), ' '), lambda w: w NOT IN ('y', '') AND {_map_sql(CARDINALS)}[w] IS NULL)) = 0
  THEN list_sum(list_transform(list_filter(string_split(lower({x}), ' '), lambda w: w NOT IN ('y', '')), lambda w: {_map_sql(CARDINALS)}[w])) WHEN len(list_filter(string_split(lower({x}), ' '), lambda w: {_map_sql({**ORDINALS, **TENS})}[w] IS NULL)) = 0 THEN list_sum(list_transform(string_split(lower({x}), ' '), lambda w: {_map_sql({**ORDINALS, **TENS})}[w])) END"""  # noqa: E731

#: Headings of articles, by number and in words (fixed patterns).
_HEADED = r"^#{2,6}\s+Artículo\s+(\d+(?:\s?(?:bis|ter|qu[aá]ter|quinquies|sexies|septies|octies|nonies|decies)\b(?:\s[a-z](?=\.))?)?)\.?\s*(.*)$"
_WORDED = r"(?i)^#{2,6}\s+Artículo\s+([a-záéíóúñ ]+?)\.?\s*$"


def law_articles(laws: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """A law's Markdown to its articles: key, n, title, block, chapter, body.

    An article begins at its heading and ends at the next article, title, chapter or disposition; other headings are
    passed over. A numbered article that repeats one, or is below the highest so far, is quoted from another law and is
    dropped with its text. Lines are numbered and carry their context along by windows over one law.
    """
    lines = laws.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    level = F.regexp_extract("line", r"^#{2,6}\s+(.*)$", 1)
    raw, words = F.regexp_extract("line", _HEADED, 1), F.regexp_extract("line", _WORDED, 1)
    lines = lines.select(key, "pos", "line", F.when(F.col("line").rlike(r"^#{2,6}\s+"), level).alias("head"), F.when(raw != "", F.translate(F.regexp_replace(raw, " ", ""), "á", "a")).alias("numbered"), F.when(words != "", number_of(words)).alias("worded"))
    lines = lines.withColumn("n", F.coalesce("numbered", F.col("worded").cast("string"))).withColumn("k", F.regexp_extract("n", r"^(\d+)", 1).try_cast("int"))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    again = F.row_number().over(Window.partitionBy(key, "n").orderBy("pos")) > 1
    lines = lines.withColumn("foreign", F.col("numbered").isNotNull() & (again | (F.col("k") < F.coalesce(F.max("k").over(before), F.lit(0)))))
    upper = F.upper(F.coalesce("head", F.lit("")))
    title, chapter = upper.startswith("TÍTULO") | upper.startswith("TITULO"), upper.startswith("CAPÍTULO")
    starts = F.col("n").isNotNull() & ~F.col("foreign")
    ends = F.col("foreign") | title | chapter | F.coalesce(F.col("head").startswith("Disposici"), F.lit(False))
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.select(
        key, "pos", "line", "head", "n", starts.alias("starts"), F.count_if(starts | ends).over(so_far).alias("part"),
        F.last(F.when(title, F.col("head")), True).over(so_far).alias("block"), F.last(F.when(title, "").when(chapter, F.col("head")), True).over(so_far).alias("chapter"),
    )
    name = F.regexp_replace(F.trim(F.regexp_extract("line", _HEADED, 2)), r"\.+$", "")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("head").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    first = lambda c: F.max(F.when(F.col("starts"), c))
    parts = lines.groupBy(key, "part").agg(first(F.col("n")).alias("n"), first(name).alias("title"), first(F.coalesce("block", F.lit(""))).alias("block"), first(F.coalesce("chapter", F.lit(""))).alias("chapter"), body.alias("body"))
    return parts.where("n IS NOT NULL").select(key, "n", "title", "block", "chapter", F.regexp_replace(F.regexp_replace(F.regexp_replace("body", r"\n{3,}", "\n\n"), r"^\s+", ""), r"\s+$", "").alias("body"))


#: An example law from a document's whole text: titles, chapters, articles by number, with suffixes and in words, one quoted, a disposition.
_LAW = r"'## TÍTULO I. ' || split_part(text, ' ', 1) || '{nl}### CAPÍTULO I{nl}##### Artículo ' || (1 + doc_id % 5) || '. Objeto.{nl}' || text || '{nl}{nl}{nl}{nl}fin{nl}##### Artículo ' || (2 + doc_id % 5) || ' bis. Otro{nl}' || split_part(text, '.', 2) || '{nl}#### Sección{nl}sigue{nl}##### Artículo 1. Citado de otra ley.{nl}no es de aquí{nl}### CAPÍTULO II{nl}##### Artículo ' || CASE WHEN doc_id % 3 = 0 THEN 'treinta y cinco' WHEN doc_id % 3 = 1 THEN 'vigésimo tercero' ELSE 'sin número' END || '.{nl}' || split_part(text, '.', 3) || '{nl}## TÍTULO II{nl}##### Artículo 40 quáter. Último.{nl}' || 'Texto: ' || text || '{nl}## Disposición final{nl}queda fuera'"
_LAWS_SQL = "laws AS (SELECT doc_id AS id, " + _LAW.format(nl="' || chr(10) || '") + " AS text FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"


@query("law_parser", rf"""WITH {_LAWS_SQL}, l AS (SELECT id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM laws),
a AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{2,6}}\s+') THEN regexp_extract(line, '^#{{2,6}}\s+(.*)$', 1) END AS head, nullif(replace(replace(regexp_extract(line, '^#{{2,6}}\s+Artículo\s+(\d+(?:\s?(?:bis|ter|qu[aá]ter|quinquies|sexies|septies|octies|nonies|decies)\b)?)\.?\s*(.*)$', 1), ' ', ''), 'á', 'a'), '') AS numbered,
  nullif(regexp_extract(line, '(?i)^#{{2,6}}\s+Artículo\s+([a-záéíóúñ ]+?)\.?\s*$', 1), '') AS words FROM l),
b AS (SELECT *, coalesce(numbered, ({_NUMBER_SQL('words')})::INT::VARCHAR) AS n FROM a), c AS (SELECT *, nullif(regexp_extract(n, '^\d+'), '')::INT AS k FROM b),
d AS (SELECT *, numbered IS NOT NULL AND (row_number() OVER (PARTITION BY id, n ORDER BY pos) > 1 OR k < coalesce(max(k) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS quoted FROM c),
e AS (SELECT *, n IS NOT NULL AND NOT quoted AS starts, starts_with(upper(coalesce(head, '')), 'TÍTULO') AS t, starts_with(upper(coalesce(head, '')), 'CAPÍTULO') AS ch, coalesce(starts_with(head, 'Disposici'), false) AS disp FROM d),
f AS (SELECT *, count(*) FILTER (WHERE starts OR quoted OR t OR ch OR disp) OVER w AS part, last_value(CASE WHEN t THEN head END IGNORE NULLS) OVER w AS block, last_value(CASE WHEN t THEN '' WHEN ch THEN head END IGNORE NULLS) OVER w AS chapter FROM e WINDOW w AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
g AS (SELECT id, part, max(n) FILTER (WHERE starts) AS n, max(regexp_replace(trim(regexp_extract(line, '^#{{2,6}}\s+Artículo\s+(\d+(?:\s?(?:bis|ter|qu[aá]ter|quinquies|sexies|septies|octies|nonies|decies)\b)?)\.?\s*(.*)$', 2)), '\.+$', '')) FILTER (WHERE starts) AS title, max(coalesce(block, '')) FILTER (WHERE starts) AS block, max(coalesce(chapter, '')) FILTER (WHERE starts) AS chapter, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE head IS NULL), '') AS body FROM f GROUP BY ALL)
SELECT id, n, title, block, chapter, md5(regexp_replace(regexp_replace(regexp_replace(body, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '')) AS body_md5 FROM g WHERE n IS NOT NULL""")
def law_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example laws to articles."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    laws = d.selectExpr("doc_id AS id", _LAW.format(nl="\\n") + " AS text")
    return law_articles(laws).select("id", "n", "title", "block", "chapter", F.md5("body").alias("body_md5"))


#: Titles of one article, and of a range of them (fixed patterns).
ONE_ARTICLE = rf"^(?i:art(?:iculo|\.)?)\s+(\d+)\s*(?:((?i:{LATIN}))\s*(\d+)?)?\s*(?:([a-z])(?![a-zñA-ZÑ]))?"
ARTICLE_RANGE = r"(?i)^arts?\.?\s+\d+\w*(?:\s+(?:bis|ter|quater))?\s+al?\s+\d+"


def article_number(title: Column) -> Column:
    """The number of one article with suffix, digit and letter, in lower case without spaces; null for a range or anything else."""
    t = F.translate(title, "áéíóú\u00a0", "aeiou ")
    whole = F.concat(*[F.lower(F.regexp_extract(t, ONE_ARTICLE, i)) for i in range(1, 5)])
    return F.when(~t.rlike(ARTICLE_RANGE) & (whole != ""), whole)


_TITLE = "CASE doc_id % 12 WHEN 0 THEN 'Artículo ' || doc_id || ' bis' WHEN 1 THEN 'Artículo 588 bis a)' WHEN 2 THEN 'Artículo ' || doc_id || ' quater' WHEN 3 THEN 'Artículo 216 bis ' || (doc_id % 9) WHEN 4 THEN 'Artículo ' || doc_id || '. Objeto' WHEN 5 THEN 'Disposición adicional primera' WHEN 6 THEN 'Art ' || doc_id || ' bis' WHEN 7 THEN 'Art. 1863 ter' WHEN 8 THEN 'Artículo 570 quáter' WHEN 9 THEN 'Arts. ' || doc_id || ' bis a 1873 bis.' WHEN 10 THEN 'Art. ' || doc_id || ' A 1253' ELSE 'ARTÍCULO ' || doc_id || ' Decies' END"


@query("article_numbers", rf"""WITH t AS (SELECT doc_id, {_TITLE} AS title FROM documents), u AS (SELECT doc_id, translate(title, 'áéíóú', 'aeiou') AS t FROM t), v AS (SELECT doc_id, t, regexp_extract(t, '^(?i:art(?:iculo|\.)?)\s+(\d+)\s*(?:((?i:{LATIN}))\s*(\d+)?)?\s*(?:([a-z])(?:[^a-zñA-ZÑ]|$))?', ['n', 'l', 'd', 'c']) AS g FROM u)
SELECT doc_id, CASE WHEN NOT regexp_matches(t, '(?i)^arts?\.?\s+\d+\w*(?:\s+(?:bis|ter|quater))?\s+al?\s+\d+') THEN nullif(lower(g.n || g.l || g.d || g.c), '') END AS n FROM v""")
def article_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of many forms to article numbers."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_TITLE} AS title").select("doc_id", article_number(F.col("title")).alias("n"))


#: The first line of a block, its date, a link with its text (fixed patterns).
BLOCK, DAY, LINK = r"^(.+?) \[#bloc\d+_[^\]]+\]$", r"^(\d{2})/(\d{2})/(\d{4})$", r"([^\[\]]{3,}?)\s*\[([^\]#][^\]]*)\]"


def dated_blocks(pages: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Key, block (from 1), title, day, links (text and url): blocks begin at ``Title [#blocN_name]``; the first line dd/mm/yyyy dates one, and one without goes."""
    start, day, link = BLOCK, DAY, LINK
    l = pages.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "raw")).select(key, "pos", F.trim("raw").alias("s"))  # noqa: E741
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("title", F.nullif(F.regexp_extract("s", start, 1), F.lit(""))).withColumn("block", F.count("title").over(w)).where("block > 0")  # noqa: E741
    in_block = Window.partitionBy(key, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    is_day = F.col("s").rlike(day)
    l = l.withColumn("dates", F.when(is_day, ~F.coalesce(F.bool_or(is_day).over(in_block), F.lit(False))).otherwise(False))  # noqa: E741
    texts = F.regexp_extract_all("s", F.lit(link), F.lit(1)), F.regexp_extract_all("s", F.lit(link), F.lit(2))
    found = F.when(F.col("title").isNull() & ~F.col("dates"), F.transform(F.arrays_zip(texts[0].alias("t"), texts[1].alias("u")), lambda x: F.struct(F.trim(F.translate(x["t"], ".·", "  ")).alias("text"), x["u"].alias("url"))))
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(found.isNotNull(), F.struct("pos", found.alias("links"))))), lambda x: x["links"]))
    iso = F.concat_ws("-", *[F.regexp_extract("s", day, i) for i in (3, 2, 1)])
    return l.groupBy(key, "block").agg(F.trim(F.max("title")).alias("title"), F.max(F.when(F.col("dates"), iso)).alias("day"), ordered.alias("links")).where("day IS NOT NULL")


_PAGE = r"'Menú{nl}' || text || ' [#bloc1_a]{nl} 0' || (1 + doc_id % 9) || '/1' || (doc_id % 3) || '/2024 {nl}Bases [/b' || doc_id || '] y Anexo uno [/c]{nl}11/11/2011{nl}Sin fecha [#bloc2_b]{nl}nada [/z]{nl}Final [#bloc3_c]{nl}2' || (doc_id % 9) || '/0' || (1 + doc_id % 9) || '/2023{nl}ab [/corto] Lista [/l]'"
_PAGE_TEXT = "(SELECT doc_id, translate(coalesce(text, ''), '[]|', '   ') AS text FROM documents)"


@query("dated_blocks", rf"""WITH p AS (SELECT doc_id AS id, {_PAGE.format(nl="' || chr(10) || '")} AS text FROM (SELECT doc_id, regexp_replace('T' || coalesce(text, ''), '[^A-Za-z ]', 'x', 'g') AS text FROM documents)), l AS (SELECT id, unnest(range(len(string_split(text, chr(10))))) AS pos, trim(unnest(string_split(text, chr(10)))) AS s FROM p),
a AS (SELECT *, nullif(regexp_extract(s, '^(.+?) \[#bloc\d+_[^\]]+\]$', 1), '') AS title FROM l), b AS (SELECT *, count(title) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block, regexp_matches(s, '^\d{{2}}/\d{{2}}/\d{{4}}$') AS d FROM a),
c AS (SELECT *, d AND row_number() OVER (PARTITION BY id, block, d ORDER BY pos) = 1 AS dates FROM b WHERE block > 0)
SELECT id, block, trim(max(title)) AS title, max(CASE WHEN dates THEN s[7:10] || '-' || s[4:5] || '-' || s[1:2] END) AS day, coalesce(sum(CASE WHEN title IS NULL AND NOT dates THEN len(regexp_extract_all(s, '([^\[\]]{{3,}}?)\s*\[([^\]#][^\]]*)\]')) END), 0)::BIGINT AS n_links, coalesce(string_agg(CASE WHEN title IS NULL AND NOT dates THEN nullif(array_to_string(regexp_extract_all(s, '([^\[\]]{{3,}}?)\s*\[([^\]#][^\]]*)\]', 2), ' '), '') END, ' ' ORDER BY pos), '') AS urls FROM c GROUP BY id, block HAVING day IS NOT NULL""")
def dated_blocks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example pages to their dated blocks with links."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.concat(F.lit("T"), F.coalesce("text", F.lit(""))), "[^A-Za-z ]", "x").alias("text"))
    b = dated_blocks(d.selectExpr("doc_id AS id", _PAGE.format(nl="\\n") + " AS text"))
    return b.select("id", "block", "title", "day", F.size("links").cast("long").alias("n_links"), F.array_join(F.transform("links", lambda x: x["url"]), " ").alias("urls"))


#: A range of days of a month, and a day (fixed patterns).
DAYS_OF_MONTH, DAY_OF_MONTH = r"del (\d+) al (\d+) de ([^\s\d]+) de (\d{4})", r"(\d{1,2}) (?:d'|de )([^\s\d]+) de (\d{4})"


def date_range(text: Column) -> tuple[Column, Column]:
    """Begin and end, as ISO text, of ``del D al D de MONTH de YYYY``; null without, or for a month that isn't one."""
    m = DAYS_OF_MONTH
    month = _map(MONTHS)[F.regexp_extract(text, m, 3)]
    iso = lambda i: F.when(month.isNotNull(), F.format_string("%s-%02d-%02d", F.regexp_extract(text, m, 4), month, F.regexp_extract(text, m, i).try_cast("int")))
    return iso(1), iso(2)


def date_in(text: Column) -> Column:
    """The first date ``D d'MONTH de YYYY`` or ``D de MONTH de YYYY`` as ISO text."""
    m = DAY_OF_MONTH
    month = _map(MONTHS)[F.regexp_extract(text, m, 2)]
    return F.when(month.isNotNull(), F.format_string("%s-%02d-%02d", F.regexp_extract(text, m, 3), month, F.regexp_extract(text, m, 1).try_cast("int")))


_CITED = "CASE doc_id % 4 WHEN 0 THEN 'Termini del ' || (1 + doc_id % 12) || ' al ' || (13 + doc_id % 15) || ' de març de 2024, cap més' WHEN 1 THEN text || ' Examen: ' || (1 + doc_id % 28) || ' d''abril de 2025' WHEN 2 THEN 'El ' || (1 + doc_id % 28) || ' de ' || CASE WHEN doc_id % 3 = 0 THEN 'setembre' ELSE 'enero' END || ' de 2023' ELSE text END"


@query("date_texts", rf"""WITH c AS (SELECT doc_id, {_CITED.replace("''abril", "''abril")} AS t FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)), r AS (SELECT doc_id, regexp_extract(t, 'del (\d+) al (\d+) de ([^\s\d]+) de (\d{{4}})', ['a', 'b', 'm', 'y']) AS r, regexp_extract(t, '(\d{{1,2}}) (?:d''|de )([^\s\d]+) de (\d{{4}})', ['d', 'm', 'y']) AS e FROM c)
SELECT doc_id, r.y || '-' || lpad({_map_sql(MONTHS)}[r.m]::VARCHAR, 2, '0') || '-' || lpad(r.a, 2, '0') AS first_day, r.y || '-' || lpad({_map_sql(MONTHS)}[r.m]::VARCHAR, 2, '0') || '-' || lpad(r.b, 2, '0') AS last_day, e.y || '-' || lpad({_map_sql(MONTHS)}[e.m]::VARCHAR, 2, '0') || '-' || lpad(e.d, 2, '0') AS day FROM r""")
def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges and dates in words to ISO dates."""
    c = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).selectExpr("doc_id", _CITED.replace("d''abril", "d\\'abril") + " AS t")
    first, last = date_range(F.col("t"))
    return c.select("doc_id", first.alias("first_day"), last.alias("last_day"), date_in(F.col("t")).alias("day"))


#: Characters of bodies after which a task hands sections on.
OUT_CHARS = 8 << 20


def _sections(lines: list[dict]) -> dict[tuple[str, str], tuple[list[str], list[str]]]:
    """The lines of one guide to the titles and the body lines of each theme's section, in the order of their first lines."""
    theme, page, own, index, placed = None, None, None, {}, []
    for x in lines:
        if x["page"] != page:
            page, own = x["page"], x["cover"]
            theme = own or theme
        if own and x["n"]:
            key = (theme, x["entry"])
            index[key] = min(index.get(key, x["n"]), x["n"])
        if theme and not own:
            placed.append((theme, x))
    now: dict[str, str] = {}
    found: dict[tuple[str, str], tuple[list[str], list[str]]] = {}
    for theme, x in placed:
        begins = "IF" if x["name"] == "ideesforça" else index.get((theme, x["name"]))
        if begins:
            now[theme] = begins
        if theme in now:
            found.setdefault((theme, now[theme]), ([], []))[0 if begins else 1].append(x["line"])
    return found


def guide_sections(guides: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """A guide, pages parted by form feeds, to its sections: key, section (such as A.1.2, or A.1.IF for the main ideas), title, body.

    A page that begins with ``Tema A.1.`` is a theme's cover, whose numbered lines are its index. On the pages up to the
    next cover a line that equals an index title begins that section; titles are compared by their first sixteen
    characters without spaces, as these files break words. Lines before a theme's first section belong to none. A guide
    is one row and is cut where it lies: lines and what they look like are expressions, a task walks over them once.
    """
    cover, entry = r"^Tema ([ABC]\.\d)\.$", r"^(\d+)\.\s+(.+)$"
    named = lambda c: F.left(F.lower(F.regexp_replace(c, r"\s+", "")), F.lit(16))
    seen = lambda page: lambda x, pos: F.struct(
        page.alias("page"), x.alias("line"), F.when(pos == 0, F.nullif(F.regexp_extract(x, cover, 1), F.lit(""))).alias("cover"), named(x).alias("name"),
        F.nullif(F.regexp_extract(x, entry, 1), F.lit("")).alias("n"), named(F.regexp_extract(x, entry, 2)).alias("entry"),
    )
    lines = F.flatten(F.transform(F.split(text, "\f"), lambda p, i: F.transform(F.filter(F.transform(F.split(p, "\n"), lambda x: F.trim(x)), lambda x: x != ""), seen(i))))
    guides = guides.select(key, lines.alias("lines"))
    kind = guides.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names, titles, bodies, size = [], [], [], [], 0
            made = lambda: pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *[pa.array(c, pa.string()) for c in (names, titles, bodies)]], [key, "section", "title", "body"])  # noqa: E731, B023
            for i in range(batch.num_rows):
                for (theme, section), (title, body) in _sections(batch.column(1)[i].as_py() or []).items():
                    keys.append(batch.column(0)[i].as_py())
                    names.append(f"{theme}.{section}")
                    titles.append(min(title))
                    bodies.append(" ".join(body))
                    size += len(bodies[-1])
                if size > OUT_CHARS:
                    yield made()
                    keys, names, titles, bodies, size = [], [], [], [], 0
            yield made()

    return guides.mapInArrow(cut, f"`{key}` {kind}, section string, title string, body string")


_GUIDE = r"'Portada{nl}res{ff}Tema A.1.{nl}Títol del tema{nl}1. La cosa primera{nl}2. Segona part del tema{ff}Capçalera{nl}La c osa primera{nl}' || text || '{nl}Segona part del tema{nl} ' || split_part(text, ' ', 2) || '{ff}més ' || split_part(text, ' ', 3) || '{nl}Idees força{nl}' || upper(text) || '{ff}Tema B.2.{nl}Altre{nl}1. Única{ff}Única{nl}' || split_part(text, ' ', 4)"


@query("guide_sections", rf"""WITH g AS (SELECT doc_id AS id, {_GUIDE.format(nl="' || chr(10) || '", ff="' || chr(12) || '")} AS text FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z ]', 'x', 'g') AS text FROM documents)),
p AS (SELECT id, unnest(range(len(string_split(text, chr(12))))) AS page, unnest(string_split(text, chr(12))) AS p FROM g), l AS (SELECT id, page, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT *, list_filter(list_transform(string_split(p, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM p)),
t AS (SELECT *, CASE WHEN pos = 0 THEN nullif(regexp_extract(line, '^Tema ([ABC]\.\d)\.$', 1), '') END AS th FROM l), o AS (SELECT *, max(th) OVER (PARTITION BY id, page) AS own, last_value(th IGNORE NULLS) OVER (PARTITION BY id ORDER BY page, pos ROWS UNBOUNDED PRECEDING) AS theme, left(lower(regexp_replace(line, '\s+', '', 'g')), 16) AS name FROM t),
i AS (SELECT id, theme, left(lower(regexp_replace(regexp_extract(line, '^(\d+)\.\s+(.+)$', 2), '\s+', '', 'g')), 16) AS name, min(regexp_extract(line, '^(\d+)\.\s+(.+)$', 1)) AS n FROM o WHERE own IS NOT NULL AND regexp_matches(line, '^(\d+)\.\s+(.+)$') GROUP BY ALL),
b AS (SELECT o.*, CASE WHEN o.name = 'ideesforça' THEN 'IF' ELSE n END AS begins FROM o LEFT JOIN i ON i.id = o.id AND i.theme = o.theme AND i.name = o.name WHERE own IS NULL AND o.theme IS NOT NULL), s AS (SELECT *, last_value(begins IGNORE NULLS) OVER (PARTITION BY id, theme ORDER BY page, pos ROWS UNBOUNDED PRECEDING) AS section FROM b)
SELECT id, theme || '.' || section AS section, min(line) FILTER (WHERE begins IS NOT NULL) AS title, md5(coalesce(string_agg(line, ' ' ORDER BY page, pos) FILTER (WHERE begins IS NULL), '')) AS body_md5 FROM s WHERE section IS NOT NULL GROUP BY ALL""")
def guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example guides to their sections."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", "x").alias("text"))
    g = d.selectExpr("doc_id AS id", _GUIDE.format(nl="\\n", ff="\\u000c") + " AS text")
    return guide_sections(g).select("id", "section", "title", F.md5("body").alias("body_md5"))
