"""Queries of the training-data operators, each over its whole table with production parameters.

Nulls, empty and very long texts, ties, repeated rows, empty tables and columns beside those that are read are treated as
the operators' ``report`` functions, ``urls.verdicts`` and ``wrappers.extract`` say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..registry import Registry
from . import bpe, centroids, mixing, neighbours, packing, quality, secrets, shards, simhash, substrings, turns, urls, wrappers
from .common import table

LLM = Registry()


@LLM.query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


@LLM.query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@LLM.query("op3_sharding")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.report(table(spark, sf_dir, "documents"))


@LLM.query("op4_url_filter", urls.SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(table(spark, sf_dir, "pages"))


@LLM.query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


@LLM.query("op7_quality_rules", quality.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


@LLM.query("op6_html_extraction")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


@LLM.query("op8_substring_dedup", substrings.SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents")).drop("removed")


@LLM.query("op9_mixing", mixing.SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


@LLM.query("op10_nearest_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.report(table(spark, sf_dir, "embeddings"))


@LLM.query("op11_centroid_clusters", centroids.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings"))


@LLM.query("op12_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@LLM.query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.report(table(spark, sf_dir, "conversations"))


@LLM.query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
