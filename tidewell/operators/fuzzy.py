"""Titles within an edit distance of two, by candidate indexes that lose no pair.

Two titles within two edits have a common string that both become by at most two deletions; short titles are indexed by
all of these. A long one is cut into three segments, of which two edits leave one whole: the other title holds it at most
two places away. Only pairs that meet in an index are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import FOLD_SQL, fold
from ..registry import query, table
from ..tables import settle

#: Titles of at most so many characters are indexed by deletions, some 330 keys each at most; longer ones by segments, 3 and 45.
SHORT = 24


def _without(s: Column) -> Column:
    """All strings that lack one character of ``s``."""
    return F.when(F.char_length(s) > 0, F.transform(F.sequence(F.lit(1), F.char_length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.char_length(s))))).otherwise(F.array().cast("array<string>"))


def _deletions(s: Column) -> Column:
    one = F.array_distinct(_without(s))
    two = F.flatten(F.transform(one, lambda t: _without(t)))
    return F.array_distinct(F.transform(F.concat(F.array(s), one, two), lambda t: F.xxhash64(t)))


def _segment(length: Column, i: int) -> tuple[Column, Column]:
    """Begin (from 1) and length of the i-th third of a string of that length."""
    third = F.floor(length / 3).cast("int")
    return third * i + 1, third if i < 2 else (length - third * 2).cast("int")


def _segment_keys(s: Column) -> Column:
    n = F.char_length(s)
    return F.array(*[F.xxhash64(n, F.lit(i), F.substring(s, *_segment(n, i))) for i in range(3)])


def _segment_probes(s: Column) -> Column:
    """Keys of the segments that a title up to two characters shorter, or as long, may share."""
    n, keys = F.char_length(s), []
    for shorter in range(3):
        m = n - shorter
        for i in range(3):
            begin, size = _segment(m, i)
            keys += [F.when((begin + d >= 1) & (begin + d + size - 1 <= n), F.xxhash64(m, F.lit(i), F.substring(s, begin + d, size))) for d in range(-2, 3)]
    return F.array_distinct(F.array_compact(F.array(*keys)))


def near_titles(titles: DataFrame, distance: int = 2) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a``, ``b``, ``distance`` of different titles within ``distance`` (1 or 2) edits, and members: id, title_id.

    ``titles`` has id (long) and title. Equal titles are one, named by the least id, so copies don't multiply pairs;
    nulls are no title, an empty title is. Keys carry ids alone and texts are fetched for the pairs that met. A key that
    many different titles share is a heavy join key, which adaptive execution splits; no pair is left out for that.
    """
    if distance not in (1, 2):
        raise ValueError("the indexes are for one or two edits")
    t = titles.where("title IS NOT NULL").select("id", "title")
    one = settle(t.groupBy("title").agg(F.min("id").alias("title_id")), "titles")
    length = F.char_length("title")
    deletions = one.where(length <= SHORT + 2).select("title_id", (length <= SHORT).alias("short"), F.explode(_deletions(F.col("title"))).alias("key"))
    others = deletions.select(F.col("title_id").alias("other"), F.col("short").alias("other_short"), "key")
    met = deletions.join(others, "key").where("title_id < other AND (short OR other_short)").select(F.col("title_id").alias("a"), F.col("other").alias("b"))
    long = one.where(length > SHORT)
    index = long.select(F.col("title_id").alias("other"), F.explode(_segment_keys(F.col("title"))).alias("key"))
    probes = long.select("title_id", F.explode(_segment_probes(F.col("title"))).alias("key"))
    also = probes.join(index, "key").where("title_id != other").select(F.least("title_id", "other").alias("a"), F.greatest("title_id", "other").alias("b"))
    pairs = met.unionByName(also).distinct()
    named = lambda name: one.select(F.col("title_id").alias(name), F.col("title").alias(f"{name}_title"))
    both = pairs.join(named("a"), "a").join(named("b"), "b").withColumn("distance", F.levenshtein("a_title", "b_title", distance))
    members = t.join(one, "title").select("id", "title_id")
    return both.where("distance >= 0").select("a", "b", "distance"), members


_TITLE = "regexp_replace(" + FOLD_SQL.format("split_part(text, chr(10), 1)") + ", '[^a-z0-9 ]+', '', 'g')"


@query("fuzzy_titles", f"""
WITH t AS MATERIALIZED (SELECT title, id, list_transform(range(97, 123), lambda c: length(title) - length(replace(title, chr(c::INT), ''))) AS h FROM (SELECT {_TITLE} AS title, min(doc_id) AS id FROM documents WHERE length(split_part(text, chr(10), 1)) <= 200 GROUP BY 1)),
k AS MATERIALIZED (SELECT x.id AS a, y.id AS b, x.title AS ta, y.title AS tb FROM t x JOIN t y ON x.id < y.id AND abs(length(x.title) - length(y.title)) <= 2 WHERE list_sum(list_transform(list_zip(x.h, y.h), lambda z: abs(z[1] - z[2]))) <= 4)
SELECT a, b, levenshtein(ta, tb)::INT AS distance FROM k WHERE levenshtein(ta, tb) <= 2
""")
def fuzzy_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents' titles, folded, that differ by at most two letters; a first line of over 200 characters is prose and no title."""
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    d = table(spark, sf_dir, "documents").where(F.char_length(first) <= 200)
    title = F.regexp_replace(fold(first), "[^a-z0-9 ]+", "")
    return near_titles(d.select(F.col("doc_id").alias("id"), title.alias("title")))[0]


@query("fuzzy_names", """
WITH t AS (SELECT p_name || ' ' || p_type AS title, min(p_partkey) AS id FROM part GROUP BY 1), k AS (SELECT x.id AS a, y.id AS b FROM t x JOIN t y ON x.id < y.id WHERE levenshtein(x.title, y.title) <= 2)
SELECT p_partkey, min(t.id) AS title_id, (SELECT count(*) FROM k WHERE k.a = min(t.id) OR k.b = min(t.id)) AS n_near FROM part JOIN t ON t.title = p_name || ' ' || p_type GROUP BY p_partkey
""")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with the class of its name and how many other names are within two letters."""
    pairs, members = near_titles(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("title")))
    ends = pairs.select(F.col("a").alias("title_id")).unionByName(pairs.select(F.col("b").alias("title_id"))).groupBy("title_id").agg(F.count(F.lit(1)).alias("n_near"))
    return members.join(ends, "title_id", "left").select(F.col("id").alias("p_partkey"), "title_id", F.coalesce("n_near", F.lit(0)).alias("n_near"))
