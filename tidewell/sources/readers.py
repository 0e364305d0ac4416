"""Readers: JSON with a default, JSON lines, files with their names, sniffed CSV, XML, content kinds."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document or array per file; no such path gives an empty frame of the schema."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A record per line; blank lines are none."""
    return spark.read.schema(schema).json(path).dropna("all")


def with_slug(spark: SparkSession, pattern: str, schema: StructType | str, name: str = r"([^/]+)\.[^.]+$") -> DataFrame:
    """Many files, each record with the part of its file's name that ``name`` captures."""
    df = spark.read.schema(schema).json(pattern, multiLine=True)
    return df.select("*", F.regexp_extract(F.col("_metadata.file_path"), name, 1).alias("slug"))


def sniffed_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A header line decides between ``;`` and ``,`` by their counts; a byte order mark is no part of a name. With a schema any bad row fails the read."""
    head = spark.read.text(path).limit(1).first()
    first = head.value.removeprefix("﻿") if head else ""
    read = spark.read.options(header=True, sep=";" if first.count(";") > first.count(",") else ",", encoding="UTF-8")
    if schema:
        return read.schema(schema).csv(path, mode="FAILFAST", enforceSchema=True)
    df = read.csv(path)
    return df.toDF(*[c.removeprefix("﻿") for c in df.columns])


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: StructType | str) -> DataFrame:
    """Elements of an XML file as rows."""
    return spark.read.schema(schema).format("xml").option("rowTag", row_tag).load(path)


def last_version(versions: Column) -> Column:
    """The newest of a block's versions."""
    return F.when(F.size(versions) > 0, F.element_at(versions, -1))


def content_kind(content_type: Column, url: Column) -> Column:
    """Html, pdf, json, xml or csv, by the content type, then by the extension; else html."""
    kind, ext = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"\.([A-Za-z0-9]+)(?:[?#]|$)", 1))
    out = F.when(F.lit(False), "")
    for k in ("pdf", "json", "csv", "html", "xml"):
        out = out.when(F.contains(kind, F.lit(k)), k)
    for k in ("pdf", "json", "csv", "xml"):
        out = out.when(ext == k, k)
    return out.otherwise("html")


def as_list(json_text: Column, element: str) -> Column:
    """A JSON scalar, object or list as an array of ``element``; what can't be read is an empty one."""
    text = F.trim(json_text)
    wrapped = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    return F.coalesce(F.from_json(wrapped, f"array<{element}>"), F.from_json(F.lit("[]"), f"array<{element}>"))
