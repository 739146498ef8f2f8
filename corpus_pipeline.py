"""The corpus pipeline: five stages over documents, each written to shared storage and read again.

Stages take (spark, docs, sf_dir) and return a DataFrame. All but the last return the columns of documents, whatever
these are called, and rows with nulls in any of them. What a stage wrote on its way is deleted once its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import op1_exact_dedup, op3_sentencepiece, op6_decontaminate, op7_language_id, op10_minhash
from tidemark.llm.common import on_all_cores, scratch, table
from tidemark.storage import temporary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known. Rejected: those without letters or other evidence, and those that no language's model explains."""
    return op7_language_id.keep_known(docs, host=F.col("source"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return op1_exact_dedup.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five words, similarity of 0.8) the one with the least doc_id."""
    return op10_minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage near to a benchmark item."""
    return op6_decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and of the decoded text."""
    return op3_sentencepiece.digests(op3_sentencepiece.encode(on_all_cores(docs.select("doc_id", "text"))))


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("decontamination", decontaminate), ("tokens", tokenise)]

#: Neither near-duplicate classes nor tokens can be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        with temporary(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{folder}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}")
    return docs
