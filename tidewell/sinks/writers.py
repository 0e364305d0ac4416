"""Writers: append-only by key, latest wins, partitions by month, no write without a change, guards."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append_new(stored: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of ``incoming`` to append: the first of each key that isn't stored."""
    w = Window.partitionBy(key).orderBy(*order)
    return incoming.join(stored.select(key), key, "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """K5, K6: the table after an upsert: of each key the row that is last in ``order``."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return stored.unionByName(incoming, allowMissingColumns=True).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_last(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """K7: the last ``n`` rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def fingerprint(df: DataFrame, ignore: tuple[str, ...] = ()) -> tuple[int, int]:
    """K9: rows and an order-free sum of row hashes, without volatile columns: equal ones need no write."""
    own = [c for c in df.columns if c not in ignore]
    n, h = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*own).cast("decimal(20,0)"))).first()
    return n, int(h or 0)


def replace(df: DataFrame, path: str) -> None:
    """K1: write beside ``path`` and take its place by renaming, so that readers see the old table or the new one whole; a failed write leaves the old."""
    spark = df.sparkSession
    staged, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("staged", "old"))
    df.write.parquet(staged)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        raise OSError(f"{path} can't be moved away")
    if not fs.rename(at(staged), at(path)):
        fs.rename(at(old), at(path))
        raise OSError(f"{staged} can't take the place of {path}")
    fs.delete(at(old), True)


def write_if_changed(df: DataFrame, old: DataFrame | None, path: str, ignore: tuple[str, ...] = ()) -> bool:
    """K1, K9: replace what is at ``path`` unless only volatile columns differ."""
    if old is not None and fingerprint(df, ignore) == fingerprint(old, ignore):
        return False
    replace(df, path)
    return True


def append_by_month(df: DataFrame, ts: str, path: str) -> None:
    """K2, K3: append JSON lines in a folder per month."""
    df.withColumn("ym", F.date_format(ts, "yyyy-MM")).write.mode("append").partitionBy("ym").json(path)


def assert_no_secret(df: DataFrame, columns: list[str], secrets: list[str]) -> None:
    """Fail before a write if a text holds one of the given secrets."""
    hit = F.exists(F.array(*[F.lit(s) for s in secrets]), lambda s: F.lit(False) if not columns else _any([F.contains(F.col(c), s) for c in columns]))
    if not df.where(hit).isEmpty():
        raise ValueError("a secret is about to be written")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
