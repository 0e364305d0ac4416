"""Sketches, fuzzy titles, functions for SQL, the gazette source and the change feed."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import sql_functions
from tidewell.operators import feeds, fuzzy, sketches
from tidewell.sources import gazette
from tidewell.streaming.jobs import finish


def test_sketch_errors_are_bounded_and_days_replace_themselves(spark, tmp_path):
    """80,000 people: estimates of a day, of three days and of an intersection lie within four standard errors; a day written again changes nothing."""
    day = F.date_add(F.lit(datetime.date(2024, 1, 1)), (F.col("id") % 4).cast("int"))
    e = spark.range(160_000).select(day.cast("timestamp").alias("ts"), (F.col("id") % 80_000 + (F.col("id") % 4) * 5_000).alias("who"), F.lit("g").alias("g"))
    path = f"{tmp_path}/sketches"
    daily = sketches.daily(e, ["g"], "who")
    sketches.store(daily, path)
    sketches.store(daily.where("day = '2024-01-02'"), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 4
    for days in (1, 3):
        exact = {r.day: r.n for r in sketches.exact_trailing(e, ["g"], "who", days).collect()}
        got = {r.day: r.e for r in sketches.trailing(stored, ["g"], days).select("day", F.hll_sketch_estimate("visitors").alias("e")).collect()}
        assert got.keys() == exact.keys() and all(abs(got[d] - n) <= 4 * sketches.ERROR * n for d, n in exact.items())
    a, b = (stored.where(f"day = '2024-01-0{i}'").select(F.col("members").alias(f"m{i}")) for i in (1, 3))
    both = a.crossJoin(b).select(F.theta_sketch_estimate(F.theta_intersection("m1", "m3")).alias("e")).first().e
    sets = [set(x.who for x in e.where(F.to_date("ts") == f"2024-01-0{i}").select("who").collect()) for i in (1, 3)]
    assert abs(both - len(sets[0] & sets[1])) <= 4 * sketches.ERROR * len(sets[0] | sets[1])


def test_sketches_of_nobody(spark):
    e = spark.createDataFrame([(None, "g", None)], "ts timestamp, g string, who long")
    assert sketches.daily(e.limit(0), ["g"], "who").count() == 0
    assert sketches.daily(e, ["g"], "who").select(F.hll_sketch_estimate("visitors")).first()[0] == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance", [1, 2])
def test_near_titles_equal_brute_force(spark, distance):
    rng = random.Random(6)
    titles = ["", "a", "b", "ab", "ba", "abc", "é", "x" * 23, "x" * 24, "x" * 25, "x" * 26, "x" * 27, "x" * 29, "xyz" * 40]
    for base in ["", "ab", "short title", "a title with just 24 ch.", "a title of twenty-five ch", "a rather long title that is cut into three segments, none of them short"] * 12:
        t = list(base)
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(0, len(t) + 1)
            kind = rng.choice("idr")
            if kind == "i":
                t.insert(at, rng.choice("abé "))
            elif at < len(t):
                t[at : at + 1] = [] if kind == "d" else [rng.choice("abé ")]
        titles.append("".join(t))
    rows = list(enumerate(titles)) + [(900, None), (901, titles[5]), (902, titles[-1])]
    pairs, members = fuzzy.near_titles(spark.createDataFrame(rows, "id long, title string"), distance)
    least = {}
    for i, t in rows:
        if t is not None:
            least[t] = min(i, least.get(t, i))
    want = {(min(least[a], least[b]), max(least[a], least[b]), d) for a, b in itertools.combinations(least, 2) if abs(len(a) - len(b)) <= distance and (d := edit_distance(a, b)) <= distance}
    got = [(r.a, r.b, r.distance) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want)
    assert {(r.id, r.title_id) for r in members.collect()} == {(i, least[t]) for i, t in rows if t is not None}
    assert fuzzy.near_titles(spark.createDataFrame(rows, "id long, title string").limit(0))[0].count() == 0


def test_functions_in_sql(spark):
    sql_functions.register(spark)
    spark.createDataFrame([(1, "One.\n\n  two \n--\n3"), (2, None), (3, ""), (4, "x" * 100_000)], "doc_id long, text string").createOrReplaceTempView("some_texts")
    got = [tuple(r) for r in spark.sql("SELECT doc_id, article, left(body, 5) FROM articles(TABLE(some_texts)) ORDER BY doc_id, article").collect()]
    assert got == [(1, 1, "One."), (1, 2, "two"), (1, 3, "3"), (4, 1, "xxxxx")]
    rows = [("a", "VALID", True), ("a", "VALID", False), ("b", "VALID", False), ("c", "VALID", True), ("c", "REJECTED", None), ("d", "what", True), ("e", None, None)]
    spark.createDataFrame(rows, "k string, v string, m boolean").createOrReplaceTempView("some_verdicts")
    got = {r.k: r.v for r in spark.sql("SELECT k, lattice_merge(v, m) AS v FROM some_verdicts GROUP BY k").collect()}
    assert got == {"a": "VALID", "b": "REVIEW_REQUIRED", "c": "REJECTED", "d": "REVIEW_REQUIRED", "e": "REVIEW_REQUIRED"}


def test_gazette_restarts_lose_and_repeat_nothing(spark, tmp_path):
    gazette.register(spark)
    path, run = f"{tmp_path}/gazette", f"{tmp_path}/run"
    rows = [(f"2024-03-{d:02}", 100 * d + i, f"call {i}" if i % 3 else None, "s") for d in range(1, 13) for i in range(6)]
    items = spark.createDataFrame(rows, "day string, item_id long, title string, section string")
    read = lambda: spark.readStream.format("gazette").option("include", "call").option("exclude", "5$").load(path)
    for begin, end in ((1, 4), (5, 5), (6, 12)):
        gazette.publish(items.where((F.substring("day", 9, 2).cast("int") >= begin) & (F.substring("day", 9, 2).cast("int") <= end)), path)
        got = finish(read(), "gazette", at=run)
        finish(read(), "gazette", at=run)  # nothing new
        want = sorted((d, i, t) for d, i, t, _ in rows if t and t != "call 5" and int(d[-2:]) <= end)
        assert sorted((r.day, r.item_id, r.title) for r in got.collect()) == want
    batch = spark.read.format("gazette").option("from", "2024-03-02").option("to", "2024-03-03").load(path)
    assert sorted({r.day for r in batch.collect()}) == ["2024-03-02", "2024-03-03"] and batch.count() == 12
    assert sorted(r.item_id for r in gazette.taken(items, "call", "5$").collect()) == [i for _, i, _ in want]


def test_gazette_leaves_an_unfinished_issue(spark, tmp_path):
    import os

    gazette.register(spark)
    path = f"{tmp_path}/gazette"
    gazette.publish(spark.createDataFrame([("2024-03-01", 1, "a", "s"), ("2024-03-02", 2, "b", "s")], "day string, item_id long, title string, section string"), path)
    os.remove(f"{path}/day=2024-03-02/_SUCCESS")
    read = lambda: spark.readStream.format("gazette").load(path)
    assert [r.item_id for r in finish(read(), "gazette", at=f"{tmp_path}/run").collect()] == [1]
    open(f"{path}/day=2024-03-02/_SUCCESS", "w").close()
    assert sorted(r.item_id for r in finish(read(), "gazette", at=f"{tmp_path}/run").collect()) == [1, 2]


def test_change_feed_replays(spark, tmp_path):
    rng = random.Random(9)
    states, now = [{}], {}
    for _ in range(4):
        now = {k: v for k, v in now.items() if rng.random() > 0.2}
        for k in range(40):
            if rng.random() < 0.3:
                now[k] = (rng.choice(["x", "y", None]), rng.randrange(100))
        states.append(dict(now))
    frame = lambda s: spark.createDataFrame([(k, *v) for k, v in s.items()], "k int, g string, n long")
    frames = [frame(s) for s in states]
    batches = [feeds.changes(a, b, "k") for a, b in zip(frames, frames[1:])]
    kept = feeds.kept_rows(spark, f"{tmp_path}/kept", "k", lambda i: [F.col(f"{i}.g").alias("g"), F.col(f"{i}.n").alias("n")])
    sums = feeds.totals(spark, f"{tmp_path}/sums", ["g"], {"n": lambda i: F.col(f"{i}.n")})
    for b in (1, 2, 2, 3, 1, 4, 3):
        kept.apply(batches[b - 1], b)
        sums.apply(batches[b - 1], b)

    def check():
        assert {r.k: (r.g, r.n) for r in feeds.rows_of(kept).collect()} == states[-1]
        want = {}
        for g, n in states[-1].values():
            c, s = want.get(g, (0, 0))
            want[g] = (c + 1, s + n)
        assert {r.g: (r._rows, r.n) for r in sums.table().collect()} == want

    check()
    assert {r.op for b in batches for r in b.collect()} == {"insert", "update", "delete"}
    sums.compact(3)
    check()
