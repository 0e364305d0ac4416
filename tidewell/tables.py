"""Durable intermediate tables in the folder that driver and executors share, and broadcasts behind a check of size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where the session names none and runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tidewell-{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here and survives lost executors.

    With ``keep`` the table outlives a ``scratch`` block.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if not keep and (made := _made.get()) is not None:
        made.append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """Tables settled in this block go at its end: for a step whose result was written in it."""
    made: list[DataFrame] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        forget(*made)


def forget(*settled: DataFrame) -> None:
    """Delete the files of settled tables that nothing reads any more."""
    for df in settled:
        spark = df.sparkSession
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_small(big: DataFrame, small: DataFrame, on: str | list[str], how: str, max_rows: int = 20_000, max_bytes: int = 16 << 20, width: str | None = None) -> DataFrame:
    """Join, broadcasting ``small`` only if it was counted and is within the bounds; beyond them Spark's shuffle join.

    ``small`` should be settled: it is read for the count. ``width`` names a string, binary or array of 8-byte numbers
    whose bytes count.
    """
    size = F.lit(0)
    if width is not None:
        bytes_of = 8 * F.size(width) if dict(small.dtypes)[width].startswith("array") else F.octet_length(width)
        size = F.coalesce(F.sum(bytes_of), F.lit(0))
    n, b = small.agg(F.count(F.lit(1)), size).first()
    return big.join(F.broadcast(small) if n <= max_rows and b <= max_bytes else small, on, how)


def in_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """The rows in a global order, settled: ``_part`` numbers Spark's ranges in that order, ``_at`` the rows within one.

    Rows of equal keys fall in one range; give a last key that differs where many may be equal.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    return settle(ranged.withColumn("_part", F.shiftright(place, 33)).withColumn("_at", place.bitwiseAND(F.lit((1 << 33) - 1))), "numbered")


def number_rows(df: DataFrame, by: list[str], out: str = "row_number") -> DataFrame:
    """Add the global row number, from 0, in the order of ``by``, nulls first; equal keys in any order among themselves.

    The sort is Spark's, over ranges; partition sizes are added up in a table of one row per partition. The sorted rows
    are written to the shared folder first, so that sizes and numbers come from the same partitions.
    """
    placed = in_ranges(df, *[F.col(c).asc_nulls_first() for c in by])
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # one row per partition
    return placed.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def running(df: DataFrame, order: list[Column], sums: dict[str, str], out: str = "row_number") -> DataFrame:
    """The global row number from 0 in ``order``, and for each name in ``sums`` the sum of its column over the rows before.

    Within a range the sums run over sorted rows, which a task spills and doesn't hold; from range to range they go
    through a table of one row per partition.
    """
    placed = in_ranges(df, *order)
    totals = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before{c}") for c in totals.columns if c != "_part"])  # one row per partition
    inner = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    based = placed.join(F.broadcast(bases), "_part").withColumn(out, F.col("_before_n") + F.col("_at"))
    for name, c in sums.items():
        based = based.withColumn(name, F.col(f"_before_sum_{name}") + F.coalesce(F.sum(c).over(inner), F.lit(0)))
    return based.select(*df.columns, out, *sums)
