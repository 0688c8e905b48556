"""A corpus cleaned and packed: quality, near copies, repeated passages, secrets, sequences.

Each stage gets what the one before it kept and returns the columns of ``documents``, but for the
last, which returns where each piece of a document lies in the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snapspan.llm import near, packing, quality, secrets, suffix
from snapspan.llm.common import read_table, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer accepts."""
    return quality.good_documents(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return near.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes and more that stand anywhere else; a text may become empty, its row stays."""
    return suffix.remove_repeats(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows."""
    return secrets.redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the sequences."""
    return packing.report(docs)


STAGES = [("quality", good), ("near_dedup", one_of_each), ("suffix_dedup", without_repeats), ("secrets", without_secrets), ("packing", packed)]

#: The quality model and the suffix sort are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
