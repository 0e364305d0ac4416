"""Structured Streaming forms of the event log: idempotent append, counters, sessions, rate limits, rule jobs.

Each job reads a folder of Parquet files as a stream, runs until all of it is read and leaves a table. ``batch`` twins
are in operators/events.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.events import idempotency_key, importance
from ..functions.common import json_int
from ..registry import query, table
from ..tables import new_path


def folder(spark: SparkSession, what: str) -> str:
    """A new folder for checkpoints and sinks in the shared place that the session names."""
    return new_path(spark, f"stream-{what}")


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 4) -> DataFrame:
    """The events as a stream; the checkpoint of a job keeps the cursor."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def finish(stream: DataFrame, what: str, mode: str = "append", at: str | None = None) -> DataFrame:
    """Run a stream over all that is there and return what its Parquet sink holds; in a folder ``at`` of an earlier run it goes on from there."""
    spark = stream.sparkSession
    at = at or folder(spark, what)
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/data").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/data")


@query("stream_idempotent", """
SELECT DISTINCT concat_ws(':', event_type, user_id::VARCHAR, substr(sha256(props), 1, 16)) AS idempotency_key FROM events
""")
def stream_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2, K4: of events with one key one is appended, over the life of the stream."""
    e = event_stream(spark, sf_dir).withColumn("idempotency_key", idempotency_key(F.col("event_type"), F.col("user_id"), F.col("props")))
    return finish(e.dropDuplicates(["idempotency_key"]).select("idempotency_key"), "idempotent")


def finish_updates(stream: DataFrame, what: str, keys: list[str]) -> DataFrame:
    """Run an aggregation in update mode; each batch's rows are kept with their batch, and a key's last ones count."""
    spark = stream.sparkSession
    at = folder(spark, what)

    def save(df: DataFrame, epoch: int) -> None:
        df.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{at}/data/epoch={epoch}")  # a batch run again replaces itself

    q = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{at}/data/*")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_epoch").alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


@query("stream_daily_counts", "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by day; an event counts however late it comes, as state has one row a day and type."""
    e = event_stream(spark, sf_dir).withColumn("t", F.col("ts").cast("timestamp"))
    counts = e.groupBy(F.window("t", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return finish_updates(counts.select(F.to_date("w.start").alias("day"), "event_type", "n"), "daily", ["day", "event_type"])


@query("stream_rule_jobs", """
SELECT event_id, CASE WHEN event_type = 'purchase' AND CAST(props->>'$.k' AS BIGINT) >= 80 THEN 1 WHEN event_type IN ('purchase', 'signup') AND CAST(props->>'$.k' AS BIGINT) >= 30 THEN 2 ELSE 4 END AS priority
FROM events WHERE event_type IN ('purchase', 'signup', 'error')
""")
def stream_rule_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of some types become jobs, in batches that are written once each."""
    e = event_stream(spark, sf_dir).where(F.col("event_type").isin("purchase", "signup", "error"))
    level = importance(F.col("event_type"), json_int(F.col("props"), "$.k"))
    jobs = e.select("event_id", F.when(level == "CRITICAL", 1).when(level == "HIGH", 2).otherwise(4).alias("priority"))
    return finish(jobs, "jobs")


_SESSIONS_SQL = """g AS (SELECT user_id, ts, coalesce(date_diff('microsecond', lag(ts) OVER w, ts) >= 43200000000, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), t AS (SELECT user_id, count(*) AS n, min(ts) AS started, max(ts) AS last_ts FROM s GROUP BY user_id, k)"""


def sessions(events: DataFrame) -> DataFrame:
    """Sessions of a user, closed by twelve quiet hours: user_id, n, started."""
    s = events.groupBy("user_id", F.session_window("t", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("started"))
    return s.select("user_id", "n", F.col("started").cast("timestamp_ntz").alias("started"))


@query("stream_sessions", f"WITH {_SESSIONS_SQL} SELECT user_id, n, started FROM t")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as a stream that waits for no event: a late one may still join two sessions, so each batch writes all of them and the last counts."""
    return finish_complete(sessions(event_stream(spark, sf_dir).withColumn("t", F.col("ts").cast("timestamp"))), "sessions")


def finish_complete(stream: DataFrame, what: str) -> DataFrame:
    """Run an aggregation in complete mode; a batch's table replaces the one before."""
    spark = stream.sparkSession
    at = folder(spark, what)

    def save(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/data/epoch={epoch}")
        spark.createDataFrame([(epoch,)], "epoch long").write.mode("overwrite").parquet(f"{at}/last")

    q = stream.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/data/epoch={spark.read.parquet(f'{at}/last').first().epoch}")


@query("stream_closed_sessions", f"WITH {_SESSIONS_SQL} SELECT user_id, n, started FROM t WHERE last_ts + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stream_closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that a watermark of one day has closed, each once and with its state gone; files come in the order of time, an event over a day late is left out."""
    return finish(sessions(event_stream(spark, sf_dir).withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", "1 day")), "closed")


@query("stream_recent_keys", """
WITH k AS (SELECT event_type, user_id, ts, lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_type, user_id, count(*) AS n FROM (SELECT DISTINCT event_type, user_id, date_trunc('day', ts) AS day FROM k) GROUP BY ALL
""")
def stream_recent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: one event of a type a user and day; keys are dropped from the state once the watermark of two days is past their day, so it doesn't grow for ever."""
    e = event_stream(spark, sf_dir).withColumn("day", F.date_trunc("day", F.col("ts").cast("timestamp")))
    once = finish(e.withWatermark("day", "2 days").dropDuplicates(["event_type", "user_id", "day"]).select("event_type", "user_id", "day"), "keys")
    return once.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("stream_rate_limit", """
SELECT event_id, n_in_hour, n_in_hour > 3 AS refused FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n_in_hour FROM events)
""")
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate limit; events are appended as they come, and each one's trailing hour is counted over all of them, as files may come in any order."""
    e = finish(event_stream(spark, sf_dir).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")), "limit")
    hour = Window.partitionBy("user_id").orderBy("t").rangeBetween(-3_600_000_000, 0)
    return e.select("event_id", F.count(F.lit(1)).over(hour).alias("n_in_hour")).withColumn("refused", F.col("n_in_hour") > 3)


@query("stream_digest", """
SELECT date_trunc('week', ts) AS week, event_type, count(*) AS n, sum(floor(value * 100 + 0.5)::BIGINT)::BIGINT AS amount FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY ALL
""")
def stream_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly digests from Monday to Monday, late events included."""
    e = event_stream(spark, sf_dir).where(F.col("event_type").isin("purchase", "signup")).withColumn("t", F.col("ts").cast("timestamp"))
    w = F.window("t", "7 days", "7 days", "4 days").alias("w")  # the epoch was a Thursday
    d = e.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long")).alias("amount"))
    return finish_updates(d.select(F.col("w.start").cast("timestamp_ntz").alias("week"), "event_type", "n", "amount"), "digest", ["week", "event_type"])
