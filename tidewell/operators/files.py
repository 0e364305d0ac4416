"""Readers and writers at work: tables written to the shared folder in a format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table
from ..sinks import writers
from ..sources import readers
from ..tables import new_path


@query("json_documents", "SELECT n_regionkey AS region, n_nationkey AS id, n_name AS name FROM nation")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array per file, in folders whose names say the region; a folder that isn't there has no rows."""
    at = new_path(spark, "json")
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))).alias("value"))  # a few rows a region
    n.write.partitionBy("n_regionkey").text(at)
    schema = "id int, name string"
    found = readers.with_slug(spark, f"{at}/n_regionkey=*/*.txt", schema, r"n_regionkey=([^/]+)/")
    return found.select(F.col("slug").cast("int").alias("region"), "id", "name").unionByName(readers.json_or_empty(spark, f"{at}-none", schema).select(F.lit(None).cast("int").alias("region"), "id", "name"))


@query("json_lines", "SELECT s_suppkey, s_name, floor(s_acctbal * 100 + 0.5)::BIGINT AS cents FROM supplier")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a line, blank lines between."""
    at = new_path(spark, "lines")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey"), "s_name", F.floor(F.col("s_acctbal") * 100 + 0.5).cast("long").alias("cents"))
    s.select(F.explode(F.array(F.to_json(F.struct("*")), F.lit(""), F.lit("  "))).alias("value")).write.text(at)
    return readers.json_lines(spark, at, "s_suppkey long, s_name string, cents long")


@query("csv_sniffed", "SELECT c_custkey::VARCHAR AS key, c_name AS name, c_mktsegment || ', ' || c_nationkey AS note, ';' AS sep FROM customer UNION ALL SELECT c_custkey::VARCHAR, c_name, c_mktsegment || ', ' || c_nationkey, ',' FROM customer")
def csv_sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of either delimiter, told by the header."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"), F.concat_ws(", ", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("note"))
    out = None
    for sep in (";", ","):
        at = new_path(spark, "csv")
        c.write.options(header=True, sep=sep).csv(at)
        read = readers.sniffed_csv(spark, at).select("key", "name", "note", F.lit(sep).alias("sep"))
        out = read if out is None else out.unionByName(read)
    return out


@query("xml_versions", "SELECT o_custkey AS block, count(*) AS n_versions, max(o_orderkey) AS last_version FROM orders GROUP BY o_custkey")
def xml_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with their versions in order, of which the last is in force."""
    at = new_path(spark, "xml")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("_id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("version"))  # a customer's orders
    o.write.format("xml").options(rowTag="block", rootTag="law").save(at)
    b = readers.xml_rows(spark, at, "block", "_id long, version array<long>")
    return b.select(F.col("_id").alias("block"), F.size("version").cast("long").alias("n_versions"), readers.last_version(F.col("version")).alias("last_version"))


@query("monthly_log", "SELECT strftime(o_orderdate, '%Y-%m') AS ym, count(*) AS n, max(o_orderkey) AS last_key FROM orders GROUP BY 1")
def monthly_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K3: a log appended to in two runs, in a folder a month."""
    at = new_path(spark, "log")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"))
    for part in (o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")):  # all orders, in two appends
        writers.append_by_month(part, "ts", at)
    log = spark.read.schema("o_orderkey long, ts timestamp_ntz, ym string").json(at)
    return log.groupBy("ym").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_key"))


@query("changed_writes", "SELECT 1 AS step, true AS written, count(*) AS n FROM supplier UNION ALL SELECT 2, false, count(*) FROM supplier UNION ALL SELECT 3, true, count(*) + 1 FROM supplier UNION ALL SELECT 4, NULL, 1")
def changed_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first write, none where only the volatile column differs, a replacement, and a write that a secret stops."""
    at = new_path(spark, "state")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.lit(1).alias("seen"))
    steps = [(1, writers.write_if_changed(s, None, at, ("seen",)), spark.read.parquet(at).count())]
    steps.append((2, writers.write_if_changed(s.withColumn("seen", F.lit(2)), spark.read.parquet(at), at, ("seen",)), spark.read.parquet(at).count()))
    more = s.unionByName(spark.createDataFrame([(-1, "key-abc", 3)], "s_suppkey long, s_name string, seen int"))
    steps.append((3, writers.write_if_changed(more, spark.read.parquet(at), at, ("seen",)), spark.read.parquet(at).count()))
    try:
        writers.assert_no_secret(spark.read.parquet(at), ["s_name"], ["key-abc"])
    except ValueError:
        steps.append((4, None, 1))
    return spark.createDataFrame(steps, "step int, written boolean, n long")


@query("content_kinds", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'json' WHEN 2 THEN 'csv' WHEN 3 THEN 'xml' ELSE 'html' END AS kind, CASE page_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS n_values FROM pages")
def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a response is, by its type or else its name; a scalar or a list of values as a list."""
    i = F.col("page_id") % 5
    kind = F.when(i == 0, "application/pdf; x").when(i == 1, "application/json").otherwise("")
    name = F.when(i == 2, "http://x/a.CSV?q=1").when(i == 3, "http://x/b.xml#f").when(i == 0, "http://x/c.html").otherwise("http://x/d")
    j = F.col("page_id") % 3
    values = F.when(j == 1, F.lit('{"v": 1}')).when(j == 2, F.lit('[{"v": 1}, {"v": 2}]'))
    return table(spark, sf_dir, "pages").select("page_id", readers.content_kind(kind, name).alias("kind"), F.size(readers.as_list(values, "struct<v:int>")).alias("n_values"))
