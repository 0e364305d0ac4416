"""Queries by name, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None = None


class Registry(dict[str, Query]):
    def query(self, name: str, sql: str | None = None) -> Callable[[Build], Build]:
        def add(build: Build) -> Build:
            if name in self:
                raise ValueError(f"two queries are named {name}")
            self[name] = Query(name, build, sql)
            return build

        return add


#: The queries of all modules outside ``llm``.
CORE = Registry()
query = CORE.query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
