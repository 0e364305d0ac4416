"""Streams with state of their own: a rate limit with a ring of accepted times, attribution by a join of two streams.

Both read events in any order within a delay that is a parameter of the source: what comes later than the watermark has
passed is left out. State goes when the watermark shows that nothing can need it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..registry import query, table
from .jobs import event_stream, finish

HOUR = 3_600_000_000  # microseconds
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Keyed state with timers needs this store; it keeps its changes in the checkpoint."""
    was = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, was)


class AcceptLimit(StatefulProcessor):
    """At most ``limit`` accepted events of a device in any hour; refused ones don't count.

    Events wait until the watermark is past them, so they are decided in the order of (time, event_id) however they
    come. A device keeps what waits and at most ``limit`` accepted times of the last hour; a timer at the first waiting
    event decides, one an hour after the last accepted event forgets the device.
    """

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "t long")
        self.waiting = handle.getListState("waiting", "t long, event_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for df in rows for r in zip(df["t"].tolist(), df["event_id"].tolist(), strict=True)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(t for t, _ in new) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = list(self.waiting.get())
        ready = sorted((t, i) for t, i in waiting if t // 1000 < now)
        rest = [(t, i) for t, i in waiting if t // 1000 >= now]
        ring = [t for (t,) in self.ring.get()]
        out = []
        for t, i in ready:
            ring = [x for x in ring if x > t - HOUR]
            refused = len(ring) >= self.limit
            out.append((i, len(ring), refused))
            if not refused:
                ring.append(t)
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(t for t, _ in rest) // 1000)
        else:
            self.waiting.clear()
        if ring and not rest and (ring[-1] + HOUR) // 1000 < now:
            ring = []
        if ring:
            self.ring.put([(t,) for t in ring])
            self.handle.registerTimer((ring[-1] + HOUR) // 1000 + 1)
        else:
            self.ring.clear()
        if out:
            ids, counts, flags = zip(*out, strict=True)
            yield pd.DataFrame({"event_id": ids, "in_hour": counts, "refused": flags})

    def close(self) -> None:
        pass


def accept_limit(events: DataFrame, limit: int = 300, delay: str = "1 hour", key: str = "user_id") -> DataFrame:
    """P4, R4 as a stream: event_id, in_hour (accepted events of the hour before), refused, once the watermark has passed an event.

    ``events`` has event_id, ts and the key. Events of one device and time are taken by event_id; those without a time
    can't be ordered and are left out. Start the query within ``rocksdb``.
    """
    e = events.where("ts IS NOT NULL").withColumn("_ts", F.col("ts").cast("timestamp")).withWatermark("_ts", delay)
    e = e.select(key, "event_id", F.unix_micros("_ts").alias("t"), "_ts")
    return e.groupBy(key).transformWithStateInPandas(AcceptLimit(limit), "event_id long, in_hour int, refused boolean", "Append", "EventTime")


@query("stream_accept_limit", """
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (
  SELECT user_id, event_id, ts, n, 0 AS in_hour, false AS refused, [ts] AS ring FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, event_id, ts, n, len(ring)::INT, len(ring) >= 3, CASE WHEN len(ring) >= 3 THEN ring ELSE list_append(ring, ts) END
  FROM (SELECT e.user_id, e.event_id, e.ts, e.n, list_filter(r.ring, lambda x: x > e.ts - INTERVAL 1 HOUR) AS ring FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
)
SELECT event_id, in_hour, refused FROM r WHERE ts < (SELECT date_trunc('hour', max(ts)) - INTERVAL 1 DAY FROM events)
""")
def stream_accept_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit as the log's own rule has it, where refused events are not stored and so don't count; what a delay of one day has closed, to the full hour."""
    with rocksdb(spark):
        decided = finish(accept_limit(event_stream(spark, sf_dir), limit=3, delay="1 day"), "accept")
    events = table(spark, sf_dir, "events")
    last = events.agg((F.date_trunc("hour", F.max("ts")) - F.expr("INTERVAL 1 DAY")).alias("t")).first().t
    closed = events.where(F.col("ts") < F.lit(last).cast("timestamp_ntz")).select("event_id")
    return decided.join(closed, "event_id", "left_semi")


def attributed(visits: DataFrame, signups: DataFrame, hours: int = 12, delay: str = "1 day") -> DataFrame:
    """A join of two streams, sign-ups with the visits of their user in the ``hours`` before: signup_id, user_id, visit_id, visit_t.

    Both have event_id, user_id and t (timestamp). Each side's watermark lets the other side's state go: a visit after
    ``hours``, a sign-up once no earlier visit can come; then a sign-up without a visit comes out with nulls. The time
    is cut into spans of ``hours`` that belong to the key, so that a busy user's state is spread; a sign-up stands in
    two of them and may have a row with nulls beside one with a visit.
    """
    span = lambda t: F.floor(F.unix_micros(t) / (hours * HOUR))
    v = visits.withWatermark("t", delay).select(F.col("user_id").alias("v_user"), F.col("event_id").alias("visit_id"), F.col("t").alias("visit_t"), span(F.col("t")).alias("v_span"))
    s = signups.withWatermark("t", delay).select("user_id", F.col("event_id").alias("signup_id"), "t", F.explode(F.array(span(F.col("t")), span(F.col("t")) - 1)).alias("span"))
    within: Column = F.expr(f"user_id = v_user AND span = v_span AND visit_t <= t AND visit_t > t - INTERVAL {hours} HOURS")
    return s.join(v, within, "leftOuter").select("signup_id", "user_id", "t", "visit_id", "visit_t")


def last_touch(pairs: DataFrame) -> DataFrame:
    """The latest visit of each sign-up, of those at one time the one with the larger id: signup_id, user_id, visit_id."""
    best = F.max(F.when(F.col("visit_id").isNotNull(), F.struct("visit_t", "visit_id"))).alias("best")
    return pairs.groupBy("signup_id", "user_id").agg(best).select("signup_id", "user_id", F.col("best.visit_id").alias("visit_id"))


def _closed(events: DataFrame, delay: str) -> DataFrame:
    """Events before the time, to the full hour, that the watermarks of both sides have passed."""
    last = F.least(*[F.max(F.when(F.col("event_type") == kind, F.col("ts"))) for kind in ("view", "signup")])
    t = events.agg((F.date_trunc("hour", last) - F.expr(f"INTERVAL {delay}")).alias("t")).first().t
    return events.where(F.col("ts") < F.lit(t).cast("timestamp_ntz"))


@query("stream_attribution", """
WITH c AS (SELECT date_trunc('hour', least(max(ts) FILTER (WHERE event_type = 'view'), max(ts) FILTER (WHERE event_type = 'signup'))) - INTERVAL 1 DAY AS t FROM events),
s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup' AND ts < (SELECT t FROM c))
SELECT s.event_id AS signup_id, s.user_id, arg_max(v.event_id, (v.ts, v.event_id)) AS visit_id FROM s LEFT JOIN events v ON v.event_type = 'view' AND v.user_id = s.user_id AND v.ts <= s.ts AND v.ts > s.ts - INTERVAL 12 HOUR
GROUP BY s.event_id, s.user_id
""")
def stream_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups with the last visit of the twelve hours before, by a join of two streams; those that a delay of one day has closed."""
    e = event_stream(spark, sf_dir).withColumn("t", F.col("ts").cast("timestamp"))
    again = event_stream(spark, sf_dir).withColumn("t", F.col("ts").cast("timestamp"))
    pairs = finish(attributed(e.where("event_type = 'view'"), again.where("event_type = 'signup'")), "attribution")
    closed = _closed(table(spark, sf_dir, "events"), "1 DAY").where("event_type = 'signup'").select(F.col("event_id").alias("signup_id"))
    return last_touch(pairs).join(closed, "signup_id", "left_semi")
