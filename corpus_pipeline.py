"""A corpus pipeline: quality, near duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import bpe, mixing, near_copies, quality, secrets
from tidewell.llm.common import forget, scratch, settle, table

#: No SQL: near duplicates (fingerprints, components), the automaton's further rules and the merges have none.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule, or whose source is rejected as a host, go.

    A null or empty text fails; a null source is a host of its own; repeated rows are judged each; columns of any name stay.
    """
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, that of the smallest doc_id.

    Texts without words are copies of each other; of rows with one doc_id one stays; rows without a doc_id stay.
    """
    return near_copies.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; documents stay. A null text stays null; repeated rows are masked alike; texts of any length are scanned whole; other columns stay as they are; an empty table stays empty."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated towards the sources' target weights and put in a global random order.

    A null source is one of its own, a null text has one byte; rows with one doc_id get equal counts.
    Texts of any length and columns of any name go along whole; an empty table stays empty.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each whole text, one row per row, with digests of the ids and of what they decode to; a null or empty text has no ids, a text of any length is encoded whole, other columns are left out, an empty table gives no row."""
    return bpe.report(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=True)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("secret scan", secret_scan), ("mixture", mixture), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote on its way goes when its result is written, the result when the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with scratch():
            docs = settle(stage(spark, docs, sf_dir), "stage", keep=True)
        forget(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
