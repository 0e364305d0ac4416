"""Streams over many files whose events are not in the order of time."""

import pytest
from conftest import SF
from pyspark.sql import functions as F
from twins import connect, differences

from tidewell.catalog import CORE


@pytest.mark.parametrize("name", ["stream_daily_counts", "stream_digest", "stream_rate_limit", "stream_sessions", "stream_idempotent", "stream_rule_jobs"])
def test_shuffled_files(spark, tmp_path, name):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(12, F.xxhash64("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    assert differences(spark, connect(SF), CORE[name], str(tmp_path)) == []


@pytest.mark.parametrize("name", ["stream_closed_sessions", "stream_recent_keys"])
def test_files_in_the_order_of_time(spark, tmp_path, name):
    """Ten files, of which four make a batch: what is open at the end of a batch goes on in the next."""
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").collect()
    for i in range(10):
        part = events[len(events) * i // 10 : len(events) * (i + 1) // 10]
        spark.createDataFrame(part, spark.read.parquet(f"{SF}/events.parquet").schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert differences(spark, connect(SF), CORE[name], str(tmp_path)) == []


def test_late_rows_of_closed_windows_are_left_out(spark, tmp_path):
    from datetime import datetime, timedelta

    begin = datetime(2024, 1, 1)
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    days = [0, 1, 2, 3, 10, 11, 12, 13, 0.4, 14, 15, 16]  # the ninth file is late
    for i, d in enumerate(days):
        spark.createDataFrame([(i, begin + timedelta(days=d), 1, "view", 1.0, "{}")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = {r.started for r in CORE["stream_closed_sessions"].build(spark, str(tmp_path)).collect()}
    assert got == {begin + timedelta(days=d) for d in days if d != 0.4 and d + 0.5 <= 16 - 1}
    assert len(CORE["stream_sessions"].build(spark, str(tmp_path)).collect()) == 12 - 1  # the late one joins the first session
