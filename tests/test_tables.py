"""Durable tables: where they lie, when they go, what is broadcast."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from tidewell import tables


class Far:
    """A session of a cluster that names no shared folder."""

    class sparkContext:
        master = "spark://host:7077"

    class conf:
        get = staticmethod(lambda key, default=None: default)


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Far)


def files(df):
    return [f.removeprefix("file://") for f in df.inputFiles()]


def test_scratch_tables_go_and_kept_ones_stay(spark):
    with tables.scratch():
        a = tables.settle(spark.range(10), "a")
        b = tables.settle(a.where("id > 3"), "b", keep=True)
        gone = files(a)
        assert all(map(os.path.exists, gone))
    assert not any(map(os.path.exists, gone)) and b.count() == 6
    outside = tables.settle(spark.range(3), "c")
    assert outside.count() == 3
    tables.forget(b, outside)
    assert not any(os.path.exists(Path(f).parent) for f in files(b) + files(outside))


def test_arrays_count_for_the_bound_of_a_broadcast(spark):
    big = spark.range(100).selectExpr("id", "id % 5 AS k").hint("shuffle_hash")
    small = tables.settle(spark.range(5).selectExpr("id AS k", "array_repeat(1.0D, 1000) AS steps"), "small")
    plan = lambda **bound: tables.join_small(big, small, "k", "left", width="steps", **bound)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan() and "broadcast" not in plan(max_bytes=39_999) and "broadcast" not in plan(max_rows=4)


def test_rows_are_numbered_within_the_order(spark):
    rows = [(f"g{i % 3}", i * 7 % 50) for i in range(50)]
    got = sorted((r.row_number, r.g, r.v) for r in tables.number_rows(spark.createDataFrame(rows, "g string, v long").repartition(6), ["g", "v"]).collect())
    assert got == [(n, *r) for n, r in enumerate(sorted(rows))]


@pytest.mark.parametrize("missing", ["public_tokenizers", "xxhash", "tidewell.llm", "corpus_pipeline"])
def test_the_entry_stands_without_the_subpackage(missing):
    """Whatever of the training-data subpackage can't be imported, the other queries are there."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'ranking' in q and not any(n.startswith('op') and n[2:3].isdigit() for n in q); assert e.oracle_sql().keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)
