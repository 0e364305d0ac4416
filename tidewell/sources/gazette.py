"""A daily gazette as a data source of Spark: days are partitions, and of a stream the date is the cursor.

A gazette is a folder with a folder ``day=YYYY-MM-DD`` of JSON lines for each issue, as a crawler or a Spark job leaves
it. ``spark.read.format("gazette")`` takes the items between ``from`` and ``to``; ``readStream`` goes on from the day
after the last one that was committed. An item is taken if its title matches ``include`` and not ``exclude``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "day string, item_id long, title string, section string"
_FOLDER = re.compile(r"day=(\d{4}-\d{2}-\d{2})$")


class Issue(InputPartition):
    """One file of one day's issue."""

    def __init__(self, day: str, path: str) -> None:
        self.day, self.path = day, path


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


class _Issues:
    """What both readers share: which days there are, and the items of a file."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.include, self.exclude = options.get("include", ""), options.get("exclude")

    def days(self) -> list[str]:
        from pyarrow import fs

        at, root = _files(self.path)
        found = (_FOLDER.search(f.path) for f in at.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.Directory)
        return sorted(m[1] for m in found if m)

    def issues(self, days: list[str]) -> list[Issue]:
        from pyarrow import fs

        at, root = _files(self.path)
        out = []
        for day in days:
            out += [Issue(day, f.path) for f in sorted(at.get_file_info(fs.FileSelector(f"{root}/day={day}")), key=lambda f: f.path) if f.is_file and not f.base_name.startswith(("_", "."))]
        return out

    def read(self, partition: Issue) -> Iterator[tuple]:
        at, _ = _files(self.path)
        include, exclude = re.compile(self.include), self.exclude and re.compile(self.exclude)
        with at.open_input_stream(partition.path) as f:
            rest = b""
            while chunk := f.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                yield from self._items(partition.day, lines, include, exclude)
            yield from self._items(partition.day, [rest], include, exclude)

    def _items(self, day: str, lines: list[bytes], include: re.Pattern, exclude: re.Pattern | None) -> Iterator[tuple]:
        for line in lines:
            if line.strip():
                item = json.loads(line)
                title = item.get("title") or ""
                if include.search(title) and not (exclude and exclude.search(title)):
                    yield (day, item.get("item_id"), item.get("title"), item.get("section"))


class GazetteReader(_Issues, DataSourceReader):
    """The items of the days from ``from`` to ``to``, both included; either may be absent."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.begin, self.end = options.get("from", ""), options.get("to", "9999-12-31")

    def partitions(self) -> list[Issue]:
        return self.issues([d for d in self.days() if self.begin <= d <= self.end])


class GazetteStreamReader(_Issues, DataSourceStreamReader):
    """Offsets are days; a batch takes the issues after the one and up to the other.

    A day counts as out once a later day or its ``_SUCCESS`` file is there, so that no issue is taken half written.
    """

    def initialOffset(self) -> dict:
        return {"day": ""}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        days = self.days()
        at, root = _files(self.path)
        if days and at.get_file_info(f"{root}/day={days[-1]}/_SUCCESS").type == fs.FileType.NotFound:
            days.pop()
        return {"day": days[-1] if days else ""}

    def partitions(self, start: dict, end: dict) -> list[Issue]:
        return self.issues([d for d in self.days() if start["day"] < d <= end["day"]])

    def commit(self, end: dict) -> None:
        """Nothing to do: Spark keeps the cursor with the query's checkpoint."""


class GazetteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gazette"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GazetteReader:
        return GazetteReader(dict(self.options))

    def streamReader(self, schema) -> GazetteStreamReader:
        return GazetteStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GazetteSource)


def publish(items: DataFrame, path: str) -> None:
    """Write items (day, item_id, title, section) as issues, each marked when all of it is there; days that are there already are replaced."""
    items.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").json(path)
    spark = items.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in items.select("day").distinct().collect():  # a row a day
        files.create(at(f"{path}/day={r.day}/_SUCCESS"), True).close()


def taken(items: DataFrame, include: str, exclude: str) -> DataFrame:
    """The same rule on a table."""
    title = F.coalesce("title", F.lit(""))
    return items.where(title.rlike(include) & ~title.rlike(exclude))
