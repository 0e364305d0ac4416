"""Operators over a global order against plain Python and Spark's own windows; hot keys over many ranges."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import ordered
from tidewell.tables import running


@pytest.fixture()
def many_ranges(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_as_of_join(spark, many_ranges):
    rng = random.Random(1)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = [(i, key(), rng.choice([None, *range(400)])) for i in range(900)]
    right = [(key(), rng.choice([None, *range(400)]), v, str(v)) for v in range(60)] + [("c", 1, 7, "7")]
    right += [r for r in right if r[0] == "hot"][:3]
    got = ordered.as_of_join(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, t int, v int, w string"), "k", "t", ["v", "w"]).collect()
    want = {}
    for i, k, t in left:
        found = [(rt, v, w) for rk, rt, v, w in right if k is not None and rk == k and t is not None and rt is not None and rt <= t]
        want[i] = (k, t, *(max(found)[1:] if found else (None, None)))
    assert {r.id: (r.k, r.t, r.v, r.w) for r in got} == want and len(got) == len(left)


def test_as_of_join_with_empty_sides(spark):
    left, right = spark.createDataFrame([(1, "a", 2)], "id int, k string, t int"), spark.createDataFrame([("a", 1, 5)], "k string, t int, v int")
    assert [tuple(r) for r in ordered.as_of_join(left, right.limit(0), "k", "t", ["v"]).collect()] == [(1, "a", 2, None)]
    assert ordered.as_of_join(left.limit(0), right, "k", "t", ["v"]).count() == 0


def test_interval_join(spark):
    rng = random.Random(2)
    points = [(i, rng.choice(["hot", "hot", "b", None]), rng.randrange(-50, 5000)) for i in range(400)]
    spans = []
    for i in range(80):
        begin = rng.randrange(-100, 5000)
        spans.append((i, rng.choice(["hot", "b", None]), begin, begin + rng.choice([0, 1, 7, 90, 4000, -3])))
    p, s = spark.createDataFrame(points, "id int, k string, t long"), spark.createDataFrame(spans, "span int, k string, b long, e long")
    got = sorted((r.id, r.span) for r in ordered.interval_join(p, s, "k", "t", "b", "e", 10).collect())
    assert got == sorted((i, j) for i, k, t in points for j, l, b, e in spans if k is not None and k == l and b <= t < e)
    assert ordered.interval_join(p, s.limit(0), "k", "t", "b", "e", 10).count() == 0


@pytest.mark.parametrize("within", [[], ["g"]])
def test_ranks(spark, many_ranges, within):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot", "hot", "x", None]), rng.choice([None, 1, 1, 1, *range(40)]), rng.randrange(3)) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, g string, a int, b int")
    w = Window.partitionBy(*within).orderBy(F.col("a").desc_nulls_last(), F.col("b").asc_nulls_last())
    names = {"rank": F.rank(), "dense_rank": F.dense_rank(), "percent_rank": F.percent_rank(), "cume_dist": F.cume_dist()}
    want = {r.id: tuple(r[n] for n in names) for r in df.select("id", *[f.over(w).alias(n) for n, f in names.items()]).collect()}
    got = {r.id: tuple(r[n] for n in names) for r in ordered.ranks(df, within, [("a", True), ("b", False)]).collect()}
    assert got == want
    for tiles in (7, 1000):
        w = Window.partitionBy(*within).orderBy(F.col("a").asc_nulls_last(), "id")
        want = {r.id: (r.n, r.t) for r in df.select("id", F.row_number().over(w).alias("n"), F.ntile(tiles).over(w).alias("t")).collect()}
        assert {r.id: (r["rank"], r.ntile) for r in ordered.ranks(df, within, [("a", False), ("id", False)], tiles).collect()} == want


def test_running_sums(spark, many_ranges):
    rows = [(i, (i * 37) % 11) for i in range(300)]
    got = sorted((r.n, r.id, r.before) for r in running(spark.createDataFrame(rows, "id int, v int"), [F.col("v").desc(), F.col("id")], {"before": "v"}, "n").collect())
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert got == [(i, r[0], sum(v for _, v in order[:i])) for i, r in enumerate(order)]


def greedy(needs, budget):
    """Slot by slot to the name that lacks most, ties by name."""
    share = {n: 0 for n, need, room in needs}
    for _ in range(budget):
        open_ = [(-(need - share[n]), n) for n, need, room in needs if share[n] < min(need, room)]
        if not open_:
            break
        share[min(open_)[1]] += 1
    return {n: s for n, s in share.items() if min(*[(need, room) for m, need, room in needs if m == n][0]) > 0}


def test_allocation_equals_the_slot_by_slot_rule(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for g in range(25):
        needs = [(f"n{i:02}", rng.randrange(0, 12), rng.choice([0, 1, 3, 100])) for i in range(rng.randrange(1, 9))]
        budget = rng.choice([0, 1, 5, 17, 1000])
        rows += [(g, n, need, room, budget) for n, need, room in needs]
        want.update({(g, n): s for n, s in greedy(needs, budget).items()})
    df = spark.createDataFrame(rows, "g int, name string, need int, room int, budget int")
    assert {(r.g, r.name): r.share for r in ordered.water_level(df, ["g"], "name", "need", "room", "budget").collect()} == want
    one = df.where("g = 3")
    assert {(3, r.name): r.share for r in ordered.water_level(one, [], "name", "need", "room", "budget").collect()} == {k: v for k, v in want.items() if k[0] == 3}


def test_slots_take_turns(spark):
    shares = spark.createDataFrame([(1, "b", 3), (1, "a", 1), (1, "c", 2), (2, "z", 2), (2, "y", 0)], "g int, name string, share long")
    got = [(r.g, r.slot, r.name, r.round) for r in ordered.interleaved(shares, ["g"], "name").orderBy("g", "slot").collect()]
    assert got == [(1, 1, "a", 1), (1, 2, "b", 1), (1, 3, "c", 1), (1, 4, "b", 2), (1, 5, "c", 2), (1, 6, "b", 3), (2, 1, "z", 1), (2, 2, "z", 2)]


def test_equal_rows_have_places_of_their_own(spark, many_ranges):
    df = spark.createDataFrame([(p, k) for p in (5, 3, None, 3) for k in (1, 1, 2) for _ in range(25)], "p int, k int")
    w = Window.orderBy(F.col("p").desc_nulls_last(), F.col("k").asc_nulls_last())
    want = df.select("p", "k", F.row_number().over(w).cast("long").alias("place"), F.ntile(7).over(w).cast("long").alias("tile"))
    key = lambda rows: sorted(map(str, map(tuple, rows)))
    assert key(ordered.tiled(df, [("p", True), ("k", False)], 7).collect()) == key(want.collect())
