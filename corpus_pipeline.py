"""A training-data pipeline over `documents`: filter, near-dedup, mask secrets, mix sources, pack sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next
stage's docs. All but the last return the columns of documents.

Null and empty texts fail the quality rules, very long ones are processed whole, repeated rows are near duplicates of
each other and leave one row, ties go to the smaller doc_id, rows without doc_id pass near_dedup, extra columns of
documents are carried along by their names, and empty documents give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import minhash, mixing, packing, rules, secrets, simhash
from leafmill.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the calibrated forest keep."""
    return rules.keep_good(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates (SimHash, then Jaccard 0.8 of 5-word shingles)."""
    return simhash.keep_first(docs, minhash.near_duplicates)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets found in it masked."""
    return secrets.mask_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the curriculum takes, in training order."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of each copy and their places in sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("mask_secrets", mask_secrets), ("mix_sources", mix_sources), ("pack", pack)]

#: Tokenising, hashing and the forest have no SQL form; tests hold each operator against brute force and run() against
#: its stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
