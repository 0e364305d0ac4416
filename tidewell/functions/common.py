"""Small column functions with fixed semantics, shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters with marks and what they fold to; the same pairs stand in the SQL twins (fixed values).
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def fold(text: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(text), MARKED, PLAIN)


FOLD_SQL = f"translate(lower({{}}), '{MARKED}', '{PLAIN}')"


def half_up(x: Column) -> Column:
    """Nearest integer, halves up, also below zero: floor(x + 0.5)."""
    return F.floor(x + 0.5).cast("long")


def cents(x: Column) -> Column:
    """Money as integer cents, halves up."""
    return F.floor(x * 100 + 0.5).cast("long")


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """A rounded share; null where the whole is zero."""
    return F.round(F.when(whole != 0, part / whole), digits)


def upper_median(values: Column) -> Column:
    """The upper middle element of an array."""
    return F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)


def json_int(text: Column, path: str) -> Column:
    return F.get_json_object(text, path).cast("long")


def as_of(events: DataFrame, ts: str = "ts") -> Column:
    """Midnight after the last event, instead of a clock: the same input gives the same rows on any day."""
    last = events.agg(F.date_trunc("day", F.max(ts)).alias("d")).first().d
    return F.lit(last).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")


AS_OF_SQL = "(SELECT date_trunc('day', max(ts)) + INTERVAL 1 DAY FROM events)"


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; two empty ones have 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Shared elements over those of the smaller set."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def words(text: Column, least: int = 1) -> Column:
    """Distinct folded words of ``least`` letters or digits and more."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(fold(text), "[^a-z0-9]+", " "), " "), lambda w: F.char_length(w) >= least))
