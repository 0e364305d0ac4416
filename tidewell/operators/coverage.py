"""Coverage and allocation: counts, gaps, concentration, quotas, apportionment, components, assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import ratio, upper_median
from ..plans.components import components
from ..registry import query, table
from ..tables import settle


@query("topic_counts", """
SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS grouped, count(*) AS n, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
""")
def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by each of two classes, both and neither; lines become one row per part and classes before they are multiplied."""
    classes = ["l_returnflag", "l_linestatus"]
    each = table(spark, sf_dir, "lineitem").groupBy("l_partkey", *classes).agg(F.count(F.lit(1)).alias("n"))
    sets = [[*classes, "l_partkey"], [classes[0], "l_partkey"], [classes[1], "l_partkey"], ["l_partkey"]]
    parts = each.groupingSets(sets, *classes, "l_partkey").agg(F.shiftright(F.grouping_id(), 1).alias("grouped"), F.sum("n").alias("n"))
    return parts.groupBy(*classes, "grouped").agg(F.sum("n").alias("n"), F.count("l_partkey").alias("n_parts"))


@query("coverage_gap", """
WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey), p AS (SELECT p_brand, p_partkey, coalesce(n, 0) AS n FROM part LEFT JOIN c ON l_partkey = p_partkey)
SELECT p_brand, count(*) AS n_parts, count(*) FILTER (WHERE n >= 25) AS covered, round(count(*) FILTER (WHERE n >= 25) / count(*), 4) AS coverage, sum(greatest(30 - n, 0))::BIGINT AS missing,
       CASE WHEN 2 * count(*) FILTER (WHERE n >= 25) < count(*) THEN 'P0' WHEN sum(greatest(30 - n, 0)) > 60 THEN 'P1' ELSE 'P2' END AS priority FROM p GROUP BY p_brand
""")
def coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered parts of a brand, what is missing to thirty lines each, a priority."""
    c = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    p = table(spark, sf_dir, "part")
    x = p.join(c, p.p_partkey == c.l_partkey, "left").select("p_brand", F.coalesce("n", F.lit(0)).alias("n"))
    covered, missing, n = F.count_if(F.col("n") >= 25), F.sum(F.greatest(30 - F.col("n"), F.lit(0))), F.count(F.lit(1))
    return x.groupBy("p_brand").agg(n.alias("n_parts"), covered.alias("covered"), ratio(covered, n).alias("coverage"), missing.alias("missing"), F.when(2 * covered < n, "P0").when(missing > 60, "P1").otherwise("P2").alias("priority"))


@query("hhi_concentration", """
WITH c AS (SELECT l_suppkey % 5 AS grp, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, l_partkey) AS r FROM c)
SELECT grp, round(sum(n * n) / (sum(n) * sum(n)), 6) AS hhi, round((sum(n) FILTER (WHERE r <= 10)) / sum(n), 4) AS top_ten, round(avg(n), 4) AS mean_n, max(n) AS max_n FROM r GROUP BY grp
""")
def hhi_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of squared shares, the share of the ten largest, mean and maximum."""
    c = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("grp"), "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    c = settle(c, "counts")
    top = c.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "l_partkey"))).where("r <= 10").groupBy("grp").agg(F.sum("n").alias("top"))  # tasks keep ten of a group
    g = c.groupBy("grp").agg(F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum("n").alias("total"), F.round(F.avg("n"), 4).alias("mean_n"), F.max("n").alias("max_n"))
    return g.join(top, "grp").select("grp", F.round(F.col("squares") / (F.col("total") * F.col("total")), 6).alias("hhi"), F.round(F.col("top") / F.col("total"), 4).alias("top_ten"), "mean_n", "max_n")


@query("over_capacity", """
SELECT p_partkey, n, least(greatest(p_size // 2, 1), 10)::BIGINT AS capacity FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey WHERE n > 2 * least(greatest(p_size // 2, 1), 10)
""")
def over_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with more lines than twice what their size bears (1 to 10)."""
    c = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    x = table(spark, sf_dir, "part").withColumn("capacity", F.least(F.greatest(F.expr("p_size div 2"), F.lit(1)), F.lit(10)).cast("long"))
    return x.join(c, x.p_partkey == c.l_partkey).where(F.col("n") > 2 * F.col("capacity")).select("p_partkey", "n", "capacity")


def largest_remainder(weights: DataFrame, group: str, key: str, weight: str, total: Column) -> DataFrame:
    """Whole numbers that add up to ``total`` in each group, in proportion to the weights; ties go to the smaller key."""
    w = Window.partitionBy(group)
    exact = total * F.col(weight) / F.sum(weight).over(w)
    x = weights.withColumn("exact", exact).withColumn("whole", F.floor("exact").cast("long")).withColumn("left_over", total - F.sum("whole").over(w))
    rank = F.row_number().over(w.orderBy(F.round(F.col("exact") - F.col("whole"), 9).desc(), key))
    return x.withColumn("seats", F.col("whole") + F.when(rank <= F.col("left_over"), 1).otherwise(0)).drop("exact", "whole", "left_over")


@query("largest_remainder", """
WITH c AS (SELECT n_regionkey AS region, c_mktsegment AS segment, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL), e AS (SELECT *, 100 * n / sum(n) OVER (PARTITION BY region) AS exact FROM c),
f AS (SELECT *, floor(exact)::BIGINT AS whole, 100 - sum(floor(exact)::BIGINT) OVER (PARTITION BY region) AS left_over, row_number() OVER (PARTITION BY region ORDER BY round(exact - floor(exact), 9) DESC, segment) AS r FROM e)
SELECT region, segment, n, whole + CASE WHEN r <= left_over THEN 1 ELSE 0 END AS seats FROM f
""")
def largest_remainder_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred seats of each region to its segments."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n = c.groupBy(F.col("n_regionkey").alias("region"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    return largest_remainder(n, "region", "segment", "n", F.lit(100)).select("region", "segment", "n", "seats")


@query("quota_sample", """
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('s1|' || doc_id), doc_id) AS r FROM documents) WHERE r <= CASE WHEN source IN ('src0', 'src1') THEN 5 ELSE 2 END
""")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample with a quota per stratum; order is by a hash, so that it holds at any partitioning."""
    r = F.row_number().over(Window.partitionBy("source").orderBy(F.md5(F.concat(F.lit("s1|"), "doc_id")), "doc_id"))
    quota = F.when(F.col("source").isin("src0", "src1"), 5).otherwise(2)
    return table(spark, sf_dir, "documents").select("doc_id", "source").withColumn("r", r).where("r <= 5").where(F.col("r") <= quota).select("doc_id", "source")


@query("evenly_spaced_sample", """
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey FROM o WHERE n <= 4 OR list_contains([floor(0 * n / 4), floor(1 * n / 4), floor(2 * n / 4), floor(3 * n / 4)], i)
""")
def evenly_spaced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four evenly spaced rows of each group."""
    w = Window.partitionBy("o_custkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").withColumns({"i": F.row_number().over(w.orderBy("o_orderkey")) - 1, "n": F.count(F.lit(1)).over(w)})
    places = F.transform(F.array(*[F.lit(k) for k in range(4)]), lambda k: F.floor(k * F.col("n") / 4))
    return o.where((F.col("n") <= 4) | F.array_contains(places, F.col("i").cast("long"))).select("o_custkey", "o_orderkey")


@query("topic_weights", """
SELECT c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS weight FROM customer GROUP BY c_mktsegment
""")
def topic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empirical weights; the window is over one row per topic."""
    n = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("weight", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("completeness_index", """
WITH s AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS a, count(DISTINCT l_partkey) AS b, count(*) FILTER (WHERE l_returnflag = 'A') AS c FROM lineitem GROUP BY l_suppkey)
SELECT s_suppkey, round((least(coalesce(a, 0), 500) / 500 + least(coalesce(b, 0), 400) / 400 + least(coalesce(c, 0), 250) / 250) / 3, 4) AS completeness FROM supplier LEFT JOIN s ON l_suppkey = s_suppkey
""")
def completeness_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of components, each capped at its target."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("a"), F.countDistinct("l_partkey").alias("b"), F.count_if(F.col("l_returnflag") == "A").alias("c"))
    p = table(spark, sf_dir, "supplier")
    part = lambda c, n: F.least(F.coalesce(c, F.lit(0)), F.lit(n)) / n
    return p.join(s, p.s_suppkey == s.l_suppkey, "left").select("s_suppkey", F.round((part("a", 500) + part("b", 400) + part("c", 250)) / 3, 4).alias("completeness"))


@query("upper_median", """
WITH c AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, min(n) AS min_n, list_sort(list(n))[len(list(n)) // 2 + 1] AS upper_median, count(*) AS n_parts FROM c GROUP BY l_suppkey
""")
def upper_median_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, upper middle and number of the counts of each group."""
    c = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("l_suppkey").agg(F.min("n").alias("min_n"), upper_median(F.collect_list("n")).alias("upper_median"), F.count(F.lit(1)).alias("n_parts"))


@query("cross_tab", """
SELECT p_type, count(*) FILTER (WHERE p_size <= 10) AS small, count(*) FILTER (WHERE p_size BETWEEN 11 AND 30) AS medium, count(*) FILTER (WHERE p_size > 30) AS large FROM part GROUP BY p_type
""")
def cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of rows by columns."""
    size = F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") <= 30, "medium").otherwise("large")
    t = table(spark, sf_dir, "part").withColumn("size", size).groupBy("p_type").pivot("size", ["small", "medium", "large"])
    return t.agg(F.count(F.lit(1))).na.fill(0)


@query("outer_merge", """
WITH a AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) > 7), b AS (SELECT p_brand, count(*) AS m FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY p_brand)
SELECT coalesce(a.p_brand, b.p_brand) AS brand, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM a FULL OUTER JOIN b ON a.p_brand = b.p_brand
""")
def outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two counters by key."""
    p = table(spark, sf_dir, "part")
    a = p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).where("n > 7")
    b = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count(F.lit(1)).alias("m"))
    return a.join(b, "p_brand", "full_outer").select(F.col("p_brand").alias("brand"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))


def component_demand(uses: DataFrame) -> DataFrame:
    """Uses (a, b, n) to one row per connected component: its numbers of a and b, the sum of n and the largest.

    Ids of a and of b are of one number space and differ. Most b have one a and decide nothing: each b stands at its least
    a, and only those with several link these to one another, so that rounds run over links between a alone.
    """
    u = uses.where("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    u = settle(u.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "n", "most"), "uses")
    least = u.groupBy("b").agg(F.min("a").alias("least"), F.max("a").alias("last"))
    shared = settle(least.where("least != last").select("b", "least"), "shared")
    c = components(u.join(shared, "b").where("a != least").select("a", F.col("least").alias("b")))
    zero = F.lit(0).cast("long")
    of_a = u.groupBy("a").agg(F.lit(1).cast("long").alias("n_a"), zero.alias("n_b"), F.sum("n").alias("n"), F.max("most").alias("most"), F.min("b").alias("b"))
    of_b = least.groupBy(F.col("least").alias("a")).agg(zero.alias("n_a"), F.count(F.lit(1)).alias("n_b"), zero.alias("n"), F.lit(None).cast("long").alias("most"), F.min("b").alias("b"))
    x = of_a.unionByName(of_b).join(c, F.col("a") == F.col("node"), "left").groupBy(F.coalesce("component", "a").alias("c"))
    x = x.agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.sum("n").alias("demand"), F.max("most").alias("most"), F.min("b").alias("b"))
    return x.select(F.least("c", "b").alias("component"), "n_a", "n_b", "demand", "most")


@query("components_demand", """
WITH RECURSIVE e AS (SELECT l_shipdate::DATE AS d, l_suppkey AS a, l_partkey AS b, count(*) AS n FROM lineitem GROUP BY ALL),
s AS (SELECT DISTINCT x.d, x.a AS x, y.a AS y FROM e x JOIN e y ON x.d = y.d AND x.b = y.b),
r AS (SELECT d, x, y FROM s UNION SELECT r.d, r.x, s.y FROM r JOIN s ON s.d = r.d AND s.x = r.y), c AS (SELECT d, x AS a, min(y) AS least FROM r GROUP BY d, x)
SELECT date_diff('day', DATE '1970-01-01', e.d) * 10000000000 + least AS component, count(DISTINCT e.a) AS n_a, count(DISTINCT e.b) AS n_b, sum(n)::BIGINT AS demand, max(n) AS most FROM e JOIN c ON c.d = e.d AND c.a = e.a GROUP BY e.d, least
""")
def components_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts that one day's lines link, as components: a day has many, from one pair to most of its lines. A component is named by its day and least supplier."""
    day = F.unix_date(F.to_date("l_shipdate")).cast("long") * 10_000_000_000
    lines = table(spark, sf_dir, "lineitem").groupBy((day + F.col("l_suppkey")).alias("a"), (day + F.col("l_partkey") + 1_000_000_000_000_000).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return component_demand(lines)


_STEMS = "list_distinct(list_filter(list_transform(string_split(regexp_replace(lower({}), '[^a-z]+', ' ', 'g'), ' '), lambda w: w[1:6]), lambda w: length(w) >= 4))"


@query("idf_assignment", f"""
WITH s AS (SELECT item_id, unnest({_STEMS.format('text')}) AS stem FROM benchmark), n AS (SELECT count(*) AS total FROM benchmark), f AS (SELECT stem, ln((1 + total) / count(*)) AS idf FROM s, n GROUP BY stem, total),
d AS (SELECT doc_id, unnest({_STEMS.format("text")}) AS stem FROM documents), x AS (SELECT doc_id, item_id, round(sum(idf), 6) AS score FROM d JOIN s USING (stem) JOIN f USING (stem) GROUP BY ALL HAVING round(sum(idf), 6) >= 2.2)
SELECT x.doc_id, x.item_id, x.score FROM x LEFT JOIN x p ON p.doc_id = x.doc_id AND p.item_id = x.item_id // 5 * 5 AND x.item_id % 5 <> 0 WHERE p.doc_id IS NULL
""")
def idf_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of each text by the summed rarity of shared stems, 2.2 or more; a chosen parent, here every fifth section, absorbs its chapters."""
    stems = lambda c: F.array_distinct(F.filter(F.transform(F.split(F.regexp_replace(F.lower(c), "[^a-z]+", " "), " "), lambda w: F.substring(w, 1, 6)), lambda w: F.char_length(w) >= 4))
    b = table(spark, sf_dir, "benchmark")
    s = b.select("item_id", F.explode(stems(F.col("text"))).alias("stem"))
    total = b.count()
    f = s.groupBy("stem").agg(F.log((1 + F.lit(total)) / F.count(F.lit(1))).alias("idf"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(stems(F.col("text"))).alias("stem"))
    x = settle(d.join(s.join(f, "stem"), "stem").groupBy("doc_id", "item_id").agg(F.round(F.sum("idf"), 6).alias("score")).where("score >= 2.2"), "scores")
    parents = x.where("item_id % 5 = 0").select("doc_id", F.col("item_id").alias("parent"))
    own = x.withColumn("parent", F.when(F.col("item_id") % 5 != 0, F.expr("item_id div 5 * 5")))
    return own.join(parents, ["doc_id", "parent"], "left_anti").select("doc_id", "item_id", "score")


@query("batch_stop_rule", """
WITH b AS (SELECT ts::DATE AS batch, count(*) AS made, count(*) FILTER (WHERE event_type = 'error') AS rejected, sum(floor(value * 100 + 0.5)::BIGINT)::BIGINT AS cost FROM events GROUP BY 1),
w AS (SELECT batch, made, sum(rejected) OVER f AS rejected5, sum(made) OVER f AS made5, sum(cost) OVER f AS cost5 FROM b WINDOW f AS (ORDER BY batch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT batch, made, round(rejected5 / made5, 4) AS rejected_share, round(cost5 / made5, 4) AS cost_each, CASE WHEN rejected5 / made5 > 0.21 THEN 'stop' WHEN cost5 / made5 > 2600 THEN 'pause' ELSE 'continue' END AS decision FROM w
""")
def batch_stop_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejections and costs over the last five batches decide; one row per batch is sorted."""
    error = F.col("event_type") == "error"
    b = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("batch")).agg(F.count(F.lit(1)).alias("made"), F.count_if(error).alias("rejected"), F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long")).alias("cost"))
    w = Window.orderBy("batch").rowsBetween(-4, 0)
    x = b.withColumns({"r": F.sum("rejected").over(w) / F.sum("made").over(w), "c": F.sum("cost").over(w) / F.sum("made").over(w)})
    return x.select("batch", "made", F.round("r", 4).alias("rejected_share"), F.round("c", 4).alias("cost_each"), F.when(F.col("r") > 0.21, "stop").when(F.col("c") > 2600, "pause").otherwise("continue").alias("decision"))


@query("status_rollup", """
SELECT o_custkey, (['F', 'P', 'O'])[max(CASE o_orderstatus WHEN 'O' THEN 3 WHEN 'P' THEN 2 ELSE 1 END)] AS worst, count(*) AS n FROM orders GROUP BY o_custkey
""")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst of ordered statuses."""
    order = F.array(F.lit("F"), F.lit("P"), F.lit("O"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.element_at(order, F.max(F.array_position(order, F.col("o_orderstatus"))).cast("int")).alias("worst"), F.count(F.lit(1)).alias("n"))


@query("priority_of_laws", """
WITH u AS (SELECT l_suppkey, l_partkey, count(*) AS uses FROM lineitem GROUP BY ALL) SELECT l_suppkey, round(sum(uses * p_size * CASE WHEN p_brand = 'Brand#2' THEN 1.5 ELSE 1 END::DOUBLE) / count(*), 4) AS priority, count(*) AS n_parts FROM u JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey
""")
def priority_of_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage weighted by size, half as much again for one brand."""
    u = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("uses"))
    x = u.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy("l_suppkey").agg(F.round(F.sum(F.col("uses") * F.col("p_size") * F.when(F.col("p_brand") == "Brand#2", 1.5).otherwise(1.0)) / F.count(F.lit(1)), 4).alias("priority"), F.count(F.lit(1)).alias("n_parts"))


@query("prefix_and_range_join", """
SELECT o_orderpriority, count(*) AS n, count(DISTINCT b.label) AS n_labels FROM orders JOIN (VALUES ('low', 0, 100000), ('mid', 100000, 300000), ('high', 300000, 10000000)) b(label, lo, hi) ON o_totalprice >= lo AND o_totalprice < hi AND o_orderpriority LIKE '%-%' GROUP BY ALL
""")
def prefix_and_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range condition against a fixed list of bands."""
    bands = spark.createDataFrame([("low", 0, 100000), ("mid", 100000, 300000), ("high", 300000, 10000000)], "label string, lo int, hi int")
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").contains("-"))
    return o.join(F.broadcast(bands), (F.col("o_totalprice") >= F.col("lo")) & (F.col("o_totalprice") < F.col("hi"))).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("n_labels"))


@query("or_join", """
SELECT count(*) AS n, count(DISTINCT c_custkey) AS n_customers FROM (SELECT c_custkey, event_id FROM customer JOIN events ON user_id = c_custkey OR event_id = c_custkey)
""")
def or_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on one key or another, as a union of two equal joins instead of a nested loop."""
    c, e = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "events").select("event_id", "user_id")
    pairs = c.join(e, F.col("c_custkey") == F.col("user_id")).select("c_custkey", "event_id").union(c.join(e, F.col("c_custkey") == F.col("event_id")).select("c_custkey", "event_id")).distinct()
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_custkey").alias("n_customers"))
