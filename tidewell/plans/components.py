"""Distributed connected components by alternating large-star and small-star steps on integer nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import forget, settle


def _stars(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a > b); every step is a combinable minimum and a join."""
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` (long) to rows ``node``, ``component``: the least node that each is connected to.

    Loops and repeated edges are allowed, edges with a null end are no edges; a node without an edge to another one has
    no row. Rounds grow with the logarithm of the longest chain; each round's edges are written to the shared folder,
    so a lost executor costs one round at most.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct()
    e = settle(e, "edges")
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now[0] == 0 or now == state:
            break
        state = now
        nxt = settle(_stars(e), "edges")
        forget(e)
        e = nxt
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
