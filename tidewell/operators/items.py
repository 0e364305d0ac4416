"""Rules for multiple-choice items: structure, content, answer, source, publication, duplicates, difficulty, states.

An item has ``id``, ``law``, ``art`` (the section it cites), ``kind``, ``stem``, ``options`` (array), ``answer`` (index from
0), ``quote``, ``explanation``, ``difficulty``, ``confidence``; its section's ``source`` text, whether that is ``in_force``,
its ``version``, and whether the section is ``in_topic``. Each rule set is a column of findings, an array in the order of
the rules, so that all rules cost one pass over the items and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import FOLD_SQL, fold
from ..registry import query, table

#: Phrases by which an option refers to others (fixed values).
REFERRING = "todas las anteriores|ninguna de las anteriores|totes les anteriors|cap de les anteriors|les dues anteriors|las dos anteriores|ambas (respuestas|opciones) (anteriores|son)|(las )?opciones? [a-d] y [a-d]|[a-d] y [a-d]|respuestas? [a-d] y [a-d]|la (primera|segunda|tercera) (opcion|respuesta)"
#: Absolute terms, folded (fixed values).
ABSOLUTE = "solo|solamente|exclusivamente|unicamente|siempre|nunca|en ningun caso|en todo caso|todos?|ninguno|nomes|solament|exclusivament|unicament|sempre|mai|en cap cas|en tot cas|tots|totes|cap"
OFFICIAL = "examen oficial|pregunta oficial|convocatoria de 20[0-9][0-9] pregunta"
CONDITIONS, NEGATIONS = "y|cuando|si|salvo|excepto|aunque|siempre que", "no|incorrecta|falsa|excepto|salvo"
#: Kinds of item: base difficulty, and whether the stem may move it by one; kinds that a person has to review.
KINDS = {"literal": (1, False), "plazos": (2, True), "negativa": (2, True), "excepcion": (3, False), "caso": (2, True)}
REVIEWED_KINDS = ("caso",)
#: Similarity of stems from which an item of the same answer repeats another, and from which it is under suspicion.
LEXICAL, SUSPICION = 0.88, 0.5


def simple(text: Column) -> Column:
    """Folded, letters a-z and digits as words with one space between."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def flat(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x{a0}]+", " "))


def has(text: Column, words: str) -> Column:
    """Whether a simple text has one of the phrases as whole words."""
    return text.rlike(rf"\b(?:{words})\b")


def _known(*rules: tuple[Column, str]) -> Column:
    """The names of the rules that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in rules]), lambda x: x.isNotNull())


def _options(test) -> Column:
    return F.exists("options", lambda o: test(F.coalesce(o, F.lit(""))))


def with_forms(items: DataFrame) -> DataFrame:
    """Items with the forms of their texts that the rules compare, each made once: ``_src``, ``_quo``, ``_stem``, ``_opts``."""
    return items.withColumns({"_src": flat(F.col("source")), "_quo": flat(F.col("quote")), "_stem": simple(F.col("stem")), "_opts": F.transform("options", simple)})


def structural_findings() -> Column:
    """``control:severity:rule`` of the bank's own checks on items ``with_forms``; where a field is missing only that is reported."""
    missing = _known(*[(F.col(c).isNull(), f"STRUCTURE:error:missing {c}") for c in ("art", "stem", "options", "answer", "quote")])
    distinct = F.size(F.array_distinct("_opts"))
    rules = _known(
        (F.size("options") != 4, "STRUCTURE:error:four options"),
        (~((F.col("answer") >= 0) & (F.col("answer") < F.size("options"))), "STRUCTURE:error:answer out of range"),
        (F.col("difficulty").isNotNull() & ~F.col("difficulty").isin(1, 2, 3), "STRUCTURE:error:difficulty"),
        (~F.char_length(F.trim("stem")).between(15, 500), "CONTENT:error:length of stem"),
        (_options(lambda o: (F.trim(o) == "") | (F.char_length(o) > 400)), "CONTENT:error:empty or long option"),
        (F.char_length(F.trim("explanation")) < 20, "CONTENT:warning:short explanation"),
        (distinct != F.size("options"), "ANSWER:error:repeated options"),
        (F.exists("_opts", lambda o: has(F.coalesce(o, F.lit("")), REFERRING)), "ANSWER:error:option refers to others"),
        (F.col("source").isNull(), "SOURCE:error:no such section"),
        (~F.contains(F.col("_src"), F.col("_quo")), "SOURCE:error:quote is not literal"),
    )
    return F.when(F.size(missing) > 0, missing).otherwise(rules)


def _at(array: str, index: Column) -> Column:
    return F.get(F.col(array), index.cast("int"))


def cut_quote() -> Column:
    """Whether a literal quote begins or ends inside a word of the source."""
    source, quote = F.col("_src"), F.col("_quo")
    place = F.instr(source, quote)
    word = "^[A-Za-z0-9]$"
    before = F.when(place > 1, F.substring(source, place - 1, F.lit(1))).otherwise("")
    after = F.substring(source, place + F.char_length(quote), F.lit(1))
    return (place > 0) & ((F.left(quote, F.lit(1)).rlike(word) & before.rlike(word)) | (F.right(quote, F.lit(1)).rlike(word) & after.rlike(word)))


def factory_findings() -> Column:
    """``state:rule`` of the checks before a judge sees an item ``with_forms``; the first three stop the rest."""
    sizes = F.transform("options", lambda o: F.char_length(o))
    right, right_size = _at("_opts", F.col("answer")), F.get(sizes, F.col("answer").cast("int"))
    others = F.filter(sizes, lambda x, i: i != F.col("answer"))
    ordered = F.array_sort(sizes)
    absolute = F.transform("_opts", lambda o: has(o, ABSOLUTE))
    n_absolute = F.size(F.filter(absolute, lambda x: x))
    valid = (F.size("options") == 4) & F.col("answer").between(0, 3)
    bank = F.transform(F.filter(structural_findings(), lambda x: ~x.endswith("no such section")), lambda x: F.concat(F.when(x.contains(":error:"), "REJECTED:").otherwise("REVIEW_REQUIRED:"), F.regexp_replace(x, ":(error|warning):", ": ")))
    first = _known((F.col("source").isNotNull() & ~F.col("in_force"), "REJECTED:section not in force"), (F.col("version").isNull(), "REJECTED:source without version"), (~F.col("in_topic"), "REJECTED:section outside the topic"), (F.char_length("_quo") < 12, "REJECTED:quote too short"))
    last = _known(
        (cut_quote(), "REJECTED:quote cut in a word"),
        (valid & (right_size > 40) & (right_size > 1.8 * F.array_max(others)), "REJECTED:right option is much longer"),
        (valid & (F.array_min(sizes) * 4 < (F.get(ordered, 1) + F.get(ordered, 2)) / 2) & (F.array_min(sizes) < 6), "REJECTED:an option is much shorter"),
        (valid & ~F.get(absolute, F.col("answer").cast("int")) & (n_absolute == 3), "REJECTED:absolute terms in wrong options only"),
        (valid & (F.char_length(right) > 12) & F.contains(F.col("_stem"), right), "REJECTED:answer in the stem"),
        (F.char_length(F.trim("explanation")) < 40, "REJECTED:short explanation"),
        ((F.char_length(F.trim("explanation")) >= 40) & ~F.regexp_like(simple(F.col("explanation")), F.concat(F.lit("art(iculo)? *"), F.regexp_extract("art", "^[0-9]*", 0))), "REJECTED:explanation doesn't name the section"),
        (has(simple(F.concat_ws(" ", "stem", "explanation")), OFFICIAL), "REJECTED:poses as official"),
        (F.col("kind").isin(*KINDS) & ~F.col("difficulty").isin(1, 2, 3), "REJECTED:difficulty out of range"),
        (F.coalesce("confidence", F.lit("baja")) != "alta", "REVIEW_REQUIRED:confidence"),
        (F.col("kind").isin(*REVIEWED_KINDS), "REVIEW_REQUIRED:kind"),
    )
    kind = _known((~F.col("kind").isin(*KINDS), "REJECTED:unknown kind"))
    complete = F.col("stem").isNotNull() & F.col("options").isNotNull() & F.col("answer").isNotNull() & F.col("quote").isNotNull() & F.col("explanation").isNotNull() & F.col("difficulty").isNotNull()
    return (
        F.when(F.col("verdict").isNotNull(), F.array(F.lit("REJECTED:the author sets a verdict")))
        .when(~complete, F.array(F.lit("REJECTED:schema")))
        .when(F.col("source").isNull(), F.concat(kind, F.array(F.lit("REJECTED:no such section"))))
        .otherwise(F.concat(kind, first, bank, last))
    )


def difficulty() -> Column:
    """The kind's difficulty, moved by one where the kind allows it and both the stem and the author say so."""
    stem = simple(F.col("stem"))
    n = F.size(F.regexp_extract_all(stem, F.lit(rf"\b({CONDITIONS})\b"), F.lit(1)))
    base = F.create_map(*[F.lit(x) for k, (d, _) in KINDS.items() for x in (k, d)])[F.col("kind")]
    may = F.col("kind").isin(*[k for k, (_, f) in KINDS.items() if f])
    up = ((n >= 3) | has(stem, NEGATIONS)) & (F.col("difficulty") == base + 1)
    down = (n == 0) & (F.col("difficulty") == base - 1)
    return F.when(may & up, F.least(F.lit(3), base + 1)).when(may & down, F.greatest(F.lit(1), base - 1)).otherwise(base)


#: What the example items are made of, in expressions that both engines read: whole sentences from all over a document
#: (a, b, c, d at its quarters, z the last), varied by doc_id.
_MADE = {
    "id": "doc_id", "law": "'ley' || (doc_id % 7)", "art": "CASE WHEN doc_id % 29 <> 0 THEN '' || (1 + doc_id % 40) END",
    "kind": "CASE WHEN doc_id % 31 = 0 THEN 'otro' WHEN doc_id % 5 = 0 THEN 'literal' WHEN doc_id % 5 = 1 THEN 'plazos' WHEN doc_id % 5 = 2 THEN 'negativa' WHEN doc_id % 5 = 3 THEN 'excepcion' ELSE 'caso' END",
    "stem": "CASE WHEN doc_id % 10 = 0 THEN split_part(z, ' ', 1) WHEN doc_id % 37 = 0 THEN 'Examen oficial: ' || b WHEN doc_id % 4 = 1 THEN 'Que dice la ley de esto: ' || b WHEN doc_id % 4 = 2 THEN 'Cual es, y cuando, si hay, salvo error: ' || c ELSE 'Cual no es, segun la ley, ' || d || '?' END",
    "options": "{array}(a, CASE WHEN doc_id % 11 = 0 THEN 'Todas las anteriores' ELSE 'Solo ' || b END, CASE WHEN doc_id % 13 = 0 THEN a ELSE 'Siempre ' || c END, CASE WHEN doc_id % 17 = 0 THEN ' ' WHEN doc_id % 19 = 0 THEN 'no' ELSE 'Nunca ' || d END)",
    "answer": "CASE WHEN doc_id % 23 = 0 THEN 4 ELSE doc_id % 4 END",
    "quote": "CASE WHEN doc_id % 53 = 0 THEN NULL WHEN doc_id % 9 = 0 THEN substr(c, 3, 8) WHEN doc_id % 6 = 0 THEN 'Otra cita que no esta' ELSE z END",
    "explanation": "CASE WHEN doc_id % 8 = 0 THEN 'Corta' WHEN doc_id % 7 = 0 THEN 'La explicacion no lo dice de ninguna manera aqui' ELSE 'Lo dice el articulo ' || (1 + doc_id % 40) || ': ' || b END",
    "difficulty": "doc_id % 4", "confidence": "CASE WHEN doc_id % 12 = 0 THEN 'media' ELSE 'alta' END", "verdict": "CASE WHEN doc_id % 41 = 0 THEN 'VALID' END",
    "source": "CASE WHEN doc_id % 59 <> 0 THEN text END", "in_force": "doc_id % 43 <> 0", "version": "CASE WHEN doc_id % 47 <> 0 THEN '2024' END", "in_topic": "doc_id % 14 <> 0",
}


#: The sentence at so many quarters of a text, and the last one; a text without any has empty ones.
_PLACES = {"a": "1", "b": "1 + n // 4", "c": "1 + n // 2", "d": "1 + n * 3 // 4", "z": "n"}


def made_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The example items, one per document, of sentences of its whole text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sentences = F.filter(F.transform(F.split("text", "[.!?\\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    d = d.withColumn("s", sentences).withColumn("n", F.size("s"))
    d = d.withColumns({k: F.when(F.col("n") > 0, F.expr(f"try_element_at(s, CAST({e.replace('//', 'DIV')} AS INT))")).otherwise("") for k, e in _PLACES.items()})
    return d.selectExpr(*[f"{e.format(array='array')} AS {n}" for n, e in _MADE.items()])


_SENTENCES_SQL = "SELECT *, len(s) AS n FROM (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '[.!?\\n]+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"
_MADE_SQL = f"quarters AS (SELECT doc_id, text, {', '.join(f'CASE WHEN n > 0 THEN list_extract(s, ({e})::INT) ELSE chr(32)[2:] END AS {k}' for k, e in _PLACES.items())} FROM ({_SENTENCES_SQL})), m AS (SELECT " + ", ".join(f"{e.format(array='list_value')} AS {n}" for n, e in _MADE.items()) + " FROM quarters)"
_SIMPLE = lambda x: f"trim(regexp_replace({FOLD_SQL.format(x)}, '[^a-z0-9]+', ' ', 'g'))"
_FLAT = lambda x: rf"trim(regexp_replace({x}, '[\s\x{{a0}}]+', ' ', 'g'))"
_HAS = lambda x, words: rf"regexp_matches({x}, '\b(?:{words})\b')"
_LIST = lambda *rules: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in rules) + "], lambda x: x IS NOT NULL)"
_ANY = lambda test: f"len(list_filter(options, lambda o: {test})) > 0"
_STRUCTURAL_SQL = f"""CASE WHEN art IS NULL OR stem IS NULL OR options IS NULL OR answer IS NULL OR quote IS NULL THEN {_LIST(*[(f"{c} IS NULL", f"STRUCTURE:error:missing {c}") for c in ("art", "stem", "options", "answer", "quote")])} ELSE {_LIST(
    ("len(options) <> 4", "STRUCTURE:error:four options"), ("answer NOT BETWEEN 0 AND len(options) - 1", "STRUCTURE:error:answer out of range"), ("difficulty NOT IN (1, 2, 3)", "STRUCTURE:error:difficulty"),
    ("length(trim(stem)) NOT BETWEEN 15 AND 500", "CONTENT:error:length of stem"), (_ANY("trim(o) = '' OR length(o) > 400"), "CONTENT:error:empty or long option"), ("length(trim(explanation)) < 20", "CONTENT:warning:short explanation"),
    (f"len(list_distinct(list_transform(options, lambda o: {_SIMPLE('o')}))) <> len(options)", "ANSWER:error:repeated options"), (_ANY(_HAS(_SIMPLE('o'), REFERRING)), "ANSWER:error:option refers to others"),
    ("source IS NULL", "SOURCE:error:no such section"), (f"NOT contains({_FLAT('source')}, {_FLAT('quote')})", "SOURCE:error:quote is not literal"))} END"""


@query("item_structure", f"WITH {_MADE_SQL} SELECT id, unnest({_STRUCTURAL_SQL}) AS finding FROM m")
def item_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank's checks of structure, content, answer and source, one row per finding."""
    return with_forms(made_items(spark, sf_dir)).select("id", F.explode(structural_findings()).alias("finding"))


_FACTORY_SQL = rf"""
f AS (SELECT *, {_STRUCTURAL_SQL} AS bank, list_transform(options, lambda o: length(o)) AS sizes, list_transform(options, lambda o: {_HAS(_SIMPLE('o'), ABSOLUTE)}) AS absolute, options[answer + 1] AS rgt,
  {_FLAT('source')} AS src, {_FLAT('quote')} AS quo, CASE WHEN kind NOT IN ('literal', 'plazos', 'negativa', 'excepcion', 'caso') THEN ['REJECTED:unknown kind'] ELSE [] END AS kinds FROM m),
g AS (SELECT *, len(options) = 4 AND answer BETWEEN 0 AND 3 AS valid, strpos(src, quo) AS place, list_max(list_filter(sizes, lambda x, i: i <> answer + 1)) AS longest, list_sort(sizes) AS ordered FROM f),
v AS (SELECT id, verdict, CASE WHEN verdict IS NOT NULL THEN ['REJECTED:the author sets a verdict'] WHEN stem IS NULL OR options IS NULL OR answer IS NULL OR quote IS NULL OR explanation IS NULL OR difficulty IS NULL THEN ['REJECTED:schema']
  WHEN source IS NULL THEN kinds || ['REJECTED:no such section']
  ELSE kinds || {_LIST(("NOT in_force", "REJECTED:section not in force"), ("version IS NULL", "REJECTED:source without version"), ("NOT in_topic", "REJECTED:section outside the topic"), ("length(quo) < 12", "REJECTED:quote too short"))}
    || list_transform(bank, lambda x: CASE WHEN contains(x, ':error:') THEN 'REJECTED:' ELSE 'REVIEW_REQUIRED:' END || regexp_replace(x, ':(error|warning):', ': '))
    || {_LIST(
    ("place > 0 AND ((regexp_matches(quo[1], '^[A-Za-z0-9]$') AND place > 1 AND regexp_matches(substr(src, place - 1, 1), '^[A-Za-z0-9]$')) OR (regexp_matches(right(quo, 1), '^[A-Za-z0-9]$') AND regexp_matches(substr(src, place + length(quo), 1), '^[A-Za-z0-9]$')))", "REJECTED:quote cut in a word"),
    ("valid AND sizes[answer + 1] > 40 AND sizes[answer + 1] > 1.8 * longest", "REJECTED:right option is much longer"), ("valid AND ordered[1] * 4 < (ordered[2] + ordered[3]) / 2 AND ordered[1] < 6", "REJECTED:an option is much shorter"),
    ("valid AND NOT absolute[answer + 1] AND len(list_filter(absolute, lambda x: x)) = 3", "REJECTED:absolute terms in wrong options only"),
    (f"valid AND length({_SIMPLE('rgt')}) > 12 AND contains({_SIMPLE('stem')}, {_SIMPLE('rgt')})", "REJECTED:answer in the stem"), ("length(trim(explanation)) < 40", "REJECTED:short explanation"),
    (f"length(trim(explanation)) >= 40 AND NOT regexp_matches({_SIMPLE('explanation')}, 'art(iculo)? *' || regexp_extract(art, '^[0-9]*'))", "REJECTED:explanation doesn''t name the section"),
    (_HAS(_SIMPLE("stem || ' ' || explanation"), OFFICIAL), "REJECTED:poses as official"), ("len(kinds) = 0 AND difficulty NOT IN (1, 2, 3)", "REJECTED:difficulty out of range"), ("coalesce(confidence, 'baja') <> 'alta'", "REVIEW_REQUIRED:confidence"), ("kind = 'caso'", "REVIEW_REQUIRED:kind"))} END AS findings FROM g)"""


@query("item_validation", f"WITH {_MADE_SQL}, {_FACTORY_SQL} SELECT id, unnest(range(1, len(findings) + 1)) AS place, unnest(findings) AS finding FROM v")
def item_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of new items before a judge, in order; those of the bank among them."""
    found = with_forms(made_items(spark, sf_dir)).select("id", F.posexplode(factory_findings()).alias("place", "finding"))
    return found.select("id", (F.col("place") + 1).cast("long").alias("place"), "finding")


_STATUS_SQL = "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 7 = 0 THEN 'OUTDATED' WHEN id % 11 = 0 THEN 'DEPRECATED' WHEN id % 5 = 0 THEN 'REVIEW_REQUIRED' WHEN id % 13 = 0 THEN 'REVIEW_REQUIRED_REEVALUATION' ELSE 'VALID' END"


@query("item_status", f"WITH {_MADE_SQL} SELECT CASE WHEN s IN ('OUTDATED', 'DEPRECATED') THEN 'retired' WHEN s = 'REVIEW_REQUIRED' THEN 'review' WHEN s = 'REVIEW_REQUIRED_REEVALUATION' THEN 'again' ELSE 'served' END AS part, count(*) AS n, min(id) AS first_id FROM (SELECT id, {_STATUS_SQL} AS s FROM m) GROUP BY ALL")
def item_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by what their status makes of them: served (none or VALID), to review, to judge again, retired."""
    s = made_items(spark, sf_dir).select("id", F.expr(_STATUS_SQL).alias("s"))
    return s.groupBy(served("s").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def served(status: str) -> Column:
    s = F.col(status)
    return F.when(s.isin("OUTDATED", "DEPRECATED"), "retired").when(s == "REVIEW_REQUIRED", "review").when(s == "REVIEW_REQUIRED_REEVALUATION", "again").otherwise("served")


@query("item_difficulty", rf"""WITH {_MADE_SQL}, x AS (SELECT *, {_SIMPLE('stem')} AS s, CASE kind WHEN 'literal' THEN 1 WHEN 'plazos' THEN 2 WHEN 'negativa' THEN 2 WHEN 'excepcion' THEN 3 WHEN 'caso' THEN 2 END AS base FROM m), y AS (SELECT *, len(regexp_extract_all(s, '\b(?:{CONDITIONS})\b')) AS n FROM x)
SELECT id, CASE WHEN kind IN ('plazos', 'negativa', 'caso') AND (n >= 3 OR {_HAS('s', NEGATIONS)}) AND difficulty = base + 1 THEN least(3, base + 1) WHEN kind IN ('plazos', 'negativa', 'caso') AND n = 0 AND difficulty = base - 1 THEN greatest(1, base - 1) ELSE base END AS judged FROM y""")
def item_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difficulty by the kind and what the stem holds; an unknown kind has none."""
    return made_items(spark, sf_dir).select("id", difficulty().alias("judged"))


#: Words that say nothing about an item (fixed values).
EMPTY_WORDS = tuple(("segons guia estudi quin quina quins quines quan qual com que per amb sense dels les los una uns unes del de la el els al als a i o en es no ni si son seva seu seus seves aquest aquesta aquests aquestes altre "
    "altres cada tot tots tota totes mateix mateixa pot poden han ha hi ho li lo ser fer fa fins entre sobre sota cap mes menys molt nomes tambe perque dins idees forca").split())  # fmt: skip
_TOKENS = lambda x: f"list_distinct(list_filter(string_split({_SIMPLE(x)}, ' '), lambda w: (length(w) > 3 OR regexp_matches(w, '^[0-9]+$')) AND w NOT IN ({', '.join(repr(w) for w in EMPTY_WORDS)})))"


def tokens(text: Column) -> Column:
    """Different words of a text that tell something: longer than three letters or numbers, without EMPTY_WORDS."""
    return F.array_distinct(F.filter(F.split(simple(text), " "), lambda w: ((F.char_length(w) > 3) | w.rlike("^[0-9]+$")) & ~w.isin(*EMPTY_WORDS)))


def share(a: Column, b: Column) -> Column:
    """Shared words over those of the smaller set; 0 where one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


_SHARE = lambda a, b: f"CASE WHEN least(len({a}), len({b})) > 0 THEN len(list_intersect({a}, {b})) / least(len({a}), len({b})) ELSE 0.0 END"


@query("item_quality", f"""WITH {_MADE_SQL}, r AS (SELECT *, options[answer + 1] AS rgt, list_max(list_transform(list_filter(options, lambda o, i: i <> answer + 1), lambda o: length(o))) AS longest, list_transform(options, lambda o: {_HAS(_SIMPLE('o'), ABSOLUTE)}) AS absolute FROM m WHERE quote IS NOT NULL AND answer BETWEEN 0 AND 3),
t AS (SELECT *, {_TOKENS('quote')} AS q, {_TOKENS('rgt')} AS r, list_distinct({_TOKENS('quote')} || {_TOKENS('stem')}) AS known, list_transform(list_filter(options, lambda o, i: i <> answer + 1), lambda o: {_TOKENS('o')}) AS wrong FROM r)
SELECT id, unnest({_LIST(("kind = 'negativa' AND len(list_filter(wrong, lambda w: " + _SHARE('w', 'q') + " < 0.5)) > 0", "quote lacks the other options"), ("kind <> 'negativa' AND " + _SHARE('r', 'known') + " < 0.5", "quote lacks the answer"),
    ("NOT absolute[answer + 1] AND len(list_filter(absolute, lambda x: x)) > 0 AND length(rgt) >= longest", "absolute terms in wrong options and the right one longest"),
    (_HAS(_SIMPLE('stem'), "quina? (norma|decret|llei|disposicio)") + " AND " + _HAS(_SIMPLE('rgt'), "(decret|llei|ordre|resolucio|decreto|ley|orden|resolucion) [0-9]+ [0-9]{4}"), "asks for a number only"), ("length(rgt) > 1.8 * longest", "right option is much longer"))}) AS finding FROM t""")
def item_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a quality audit asks a person about, whatever a judge said."""
    m = made_items(spark, sf_dir).where("quote IS NOT NULL AND answer BETWEEN 0 AND 3").withColumn("right", _at("options", F.col("answer")))
    wrong = F.filter("options", lambda o, i: i != F.col("answer"))
    m = m.withColumns({"q": tokens(F.col("quote")), "r": tokens(F.col("right")), "longest": F.array_max(F.transform(wrong, lambda o: F.char_length(o))), "absolute": F.transform("options", lambda o: has(simple(o), ABSOLUTE))})
    stem = simple(F.col("stem"))
    found = _known(
        ((F.col("kind") == "negativa") & F.exists(wrong, lambda o: share(tokens(o), F.col("q")) < 0.5), "quote lacks the other options"),
        ((F.col("kind") != "negativa") & (share(F.col("r"), F.array_union("q", tokens(F.col("stem")))) < 0.5), "quote lacks the answer"),
        (~F.get("absolute", F.col("answer").cast("int")) & F.exists("absolute", lambda x: x) & (F.char_length("right") >= F.col("longest")), "absolute terms in wrong options and the right one longest"),
        (has(stem, "quina? (norma|decret|llei|disposicio)") & has(simple(F.col("right")), "(decret|llei|ordre|resolucio|decreto|ley|orden|resolucion) [0-9]+ [0-9]{4}"), "asks for a number only"),
        (F.char_length("right") > 1.8 * F.col("longest"), "right option is much longer"),
    )
    return m.select("id", F.explode(found).alias("finding"))
