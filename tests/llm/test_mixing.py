import hashlib
import math
from collections import Counter

import duckdb
from conftest import SF
from pyspark.sql import functions as F

from tidewell.llm import mixing
from tidewell.llm.common import table


def uniform(*parts):
    return int(hashlib.md5("|".join([mixing.SEED, *map(str, parts)]).encode()).hexdigest()[:13], 16) / (1 << 52)


def poisson(rate, u):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u and k < 400:
        k += 1
        p *= rate / k
        total += p
    return k


def test_counts_invert_the_distribution(spark):
    docs = table(spark, SF, "documents")
    rows = docs.collect()
    size = Counter()
    for r in rows:
        size[r.source] += len(r.text.encode()) + 1
    wish = {s: b**0.7 for s, b in size.items()}
    rate = {s: wish[s] / sum(wish.values()) * sum(size.values()) / b for s, b in size.items()}
    want = Counter({r.doc_id: poisson(rate[r.source], uniform(r.doc_id)) for r in rows})
    got = mixing.report(docs).collect()
    assert Counter(r.doc_id for r in got) == +want
    assert [r.mix_key for r in got] == sorted(r.mix_key for r in got)
    assert all(r.mix_key == uniform(r.doc_id, r.copy) for r in got)
    out = mixing.mix(docs)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [r.doc_id for r in got]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted((r.doc_id, r.source, r.n_copies, r.copy, r.mix_key) for r in got) == sorted(con.sql(mixing.SQL).fetchall())


def test_weights_nulls_and_repeats(spark):
    rows = [(i, "t" * 9, "a" if i % 3 else "b", 0) for i in range(3000)] + [(9000, None, None, 1), (9001, "", "c", 1), (0, "t" * 9, "b", 2), (None, "x", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_copies int")
    out = mixing.mix(docs, {"a": 0.2, "b": 0.8}).collect()
    share = Counter(r.source for r in out)
    assert set(share) <= {"a", "b"} and abs(share["b"] / len(out) - 0.8) < 0.03 and abs(len(out) / 3000 - 1) < 0.1
    mixing.mix(docs).count()
    assert mixing.mix(docs.limit(0)).count() == 0


def test_steps_reach_one(spark):
    got = spark.sql("SELECT explode(array(0.0D, 0.01D, 3.5D, 60.0D, 300.0D)) AS rate").select("rate", mixing.poisson_steps(mixing.F.col("rate")).alias("s")).collect()
    for r in got:
        assert abs(r.s[-1] - 1) < 1e-12 and sorted(r.s) == r.s


def test_large_rates(spark):
    """Beyond exp(-rate)'s reach the table begins below the mean; it equals the distribution by logarithms."""
    df = spark.createDataFrame([(x,) for x in (650.0, 701.5, 5000.0)], "rate double").select("rate", mixing.poisson_start(F.col("rate")).alias("start"), mixing.poisson_steps(F.col("rate")).alias("steps"))
    for r in df.collect():
        total, k = 0.0, 0
        want = []
        while k < r.start + len(r.steps):
            total += math.exp(k * math.log(r.rate) - r.rate - math.lgamma(k + 1))
            if k >= r.start:
                want.append(total)
            k += 1
        assert (r.start > 0) == (r.rate > mixing.LARGE)
        assert max(abs(a - b) for a, b in zip(r.steps, want, strict=True)) < 1e-9
        assert abs(r.steps[-1] - 1) < 1e-9
        median = r.start + sum(x <= 0.5 for x in r.steps)
        assert abs(median - r.rate) <= 1


def test_clashing_columns_and_repeats(spark):
    rows = [(i % 40, "t" * (1 + i % 3), "ab"[i % 2], "s", 9.0, 1, 2) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_source string, mix_rate double, steps int, n_copies int")
    a, b = mixing.mix(docs).collect(), mixing.mix(docs.repartition(7)).collect()
    assert a == b and len(a) > 40 and mixing.mix(docs).columns == docs.columns
    assert {(r.mix_source, r.mix_rate, r.steps, r.n_copies) for r in a} == {("s", 9.0, 1, 2)}


def test_many_large_tables_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, "t", f"s{i % 3000}") for i in range(6000)], "doc_id long, text string, source string")
    plain = mixing.copies(docs)
    weights = {f"s{i}": 1.0 for i in range(3000)}
    assert mixing.copies(docs, weights).where("n_copies >= 0").count() == plain.count() == 6000
    high = mixing.rates(docs, {"s0": 1.0})
    assert high.where("mix_source = '=s0'").first().rate == 3000.0


def test_rows_without_a_doc_id_are_counted_each(spark):
    rows = [(None, f"text {i}", "a") for i in range(2000)] + [(i, f"more {i}", "b") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counts = {r.n_copies for r in mixing.copies(docs, {"a": 0.5, "b": 0.5}).where("doc_id IS NULL").collect()}
    assert len(counts) > 2
    got = mixing.report(docs).collect()
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, ((r.doc_id, r.source, r.n_copies, r.copy, r.mix_key) for r in got))) == sorted(map(key, con.sql(mixing.SQL).fetchall()))


def test_partitions_follow_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "t" * 1000, "ab"[i % 2]) for i in range(500)], "doc_id long, text string, source string")
    before = [r.doc_id for r in mixing.mix(docs).collect()]
    monkeypatch.setattr(mixing, "PARTITION", 10_000)
    after = mixing.mix(docs)
    assert after.rdd.getNumPartitions() >= 50 and [r.doc_id for r in after.collect()] == before
    assert mixing.report(docs).rdd.getNumPartitions() < 10
