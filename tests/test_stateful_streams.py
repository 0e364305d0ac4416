"""Streams with state: several files, late rows, a restart from the checkpoint, bounded state."""

import random
from datetime import datetime, timedelta

import pytest
from conftest import SF
from pyspark.sql import functions as F
from twins import connect, differences

from tidewell.catalog import CORE
from tidewell.streaming import stateful
from tidewell.streaming.jobs import event_stream, finish

BEGIN = datetime(2024, 1, 1)


def greedy(rows, limit):
    """The rule in plain Python; rows: (event_id, ts, user_id)."""
    out, rings = {}, {}
    for i, t, user in sorted(rows, key=lambda r: (r[1], r[0])):
        ring = rings[user] = [x for x in rings.get(user, []) if x > t - timedelta(hours=1)]
        out[i] = (len(ring), len(ring) >= limit)
        if len(ring) < limit:
            ring.append(t)
    return out


def made(seed, n):
    rng = random.Random(seed)
    return [(i, BEGIN + timedelta(seconds=rng.randrange(0, 200_000)), rng.choice([1, 1, 1, 2, None])) for i in range(n)]


def files(spark, path, rows, order, kind=lambda i: "view"):
    """Rows in files as ``order`` groups them."""
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    for part in order:
        spark.createDataFrame([(i, t, u, kind(i), 1.0, "{}") for i, t, u in part], schema).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")


def test_limit_over_late_files_and_a_restart(spark, tmp_path):
    rows = made(1, 600)
    late = sorted(rows, key=lambda r: r[1] + timedelta(hours=random.Random(r[0]).uniform(0, 5)))  # up to five hours late
    parts = [late[k : k + 60] for k in range(0, 600, 60)]
    stream = lambda: stateful.accept_limit(event_stream(spark, str(tmp_path), 1), limit=4, delay="6 hours")
    with stateful.rocksdb(spark):
        files(spark, tmp_path, rows, parts[:5])
        finish(stream(), "limit", at=f"{tmp_path}/run")
        files(spark, tmp_path, rows, parts[5:])
        got = finish(stream(), "limit", at=f"{tmp_path}/run").collect()
    want, end = greedy(rows, 4), max(t for _, t, _ in rows) - timedelta(hours=6)
    closed = {i for i, t, _ in rows if t < end - timedelta(seconds=1)}
    found = {r.event_id: (r.in_hour, r.refused) for r in got}
    assert len(found) == len(got) and closed <= found.keys()
    assert found == {i: want[i] for i in found}
    assert any(r for _, r in found.values())


def test_state_of_the_limit_goes(spark, tmp_path):
    """Devices that went quiet leave the state; the others keep a ring of the limit's size."""
    rows = [(i, BEGIN + timedelta(minutes=i), i // 10) for i in range(200)] + [(1000, BEGIN + timedelta(days=2), 99), (1001, BEGIN + timedelta(days=3), 99)]
    files(spark, tmp_path, rows, [rows[:100], rows[100:200], rows[200:201], rows[201:]])
    with stateful.rocksdb(spark):
        got = finish(stateful.accept_limit(event_stream(spark, str(tmp_path), 1), limit=3, delay="1 minute"), "limit", at=f"{tmp_path}/run")
        state = spark.read.format("statestore").option("stateVarName", "ring").load(f"{tmp_path}/run/state")
        assert {r.key.user_id for r in state.select("key").collect()} <= {99}
    assert got.count() == 201


def test_attribution_over_late_files_and_a_restart(spark, tmp_path):
    rows = made(2, 500)
    kind = lambda i: "signup" if i % 4 == 0 else "view"
    late = sorted(rows, key=lambda r: r[1] + timedelta(hours=random.Random(r[0]).uniform(0, 5)))
    parts = [late[k : k + 50] for k in range(0, 500, 50)]

    def run():
        e = event_stream(spark, str(tmp_path), 1).withColumn("t", F.col("ts").cast("timestamp"))
        again = event_stream(spark, str(tmp_path), 1).withColumn("t", F.col("ts").cast("timestamp"))
        return finish(stateful.attributed(e.where("event_type = 'view'"), again.where("event_type = 'signup'"), hours=2, delay="6 hours"), "attribution", at=f"{tmp_path}/run")

    files(spark, tmp_path, rows, parts[:5], kind)
    run()
    files(spark, tmp_path, rows, parts[5:], kind)
    pairs = run()
    got = {r.signup_id: r.visit_id for r in stateful.last_touch(pairs).collect()}
    want = {}
    for i, t, u in rows:
        if kind(i) == "signup":
            seen = [(vt, v) for v, vt, w in rows if kind(v) == "view" and u is not None and w == u and t - timedelta(hours=2) < vt <= t]
            want[i] = max(seen)[1] if seen else None
    end = min(max(t for i, t, _ in rows if kind(i) == k) for k in ("view", "signup")) - timedelta(hours=6)
    closed = {i for i, t, _ in rows if kind(i) == "signup" and t < end - timedelta(seconds=1)}
    assert {i: got[i] for i in closed} == {i: want[i] for i in closed} and any(want[i] is None for i in closed) and len({want[i] for i in closed}) > 20
    assert pairs.where("visit_id IS NOT NULL").groupBy("signup_id", "visit_id").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("name", ["stream_accept_limit", "stream_attribution"])
def test_files_in_the_order_of_time(spark, tmp_path, name):
    events = spark.read.parquet(f"{SF}/events.parquet")
    rows = events.orderBy("ts").collect()
    for i in range(10):
        spark.createDataFrame(rows[len(rows) * i // 10 : len(rows) * (i + 1) // 10], events.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert differences(spark, connect(SF), CORE[name], str(tmp_path)) == []
