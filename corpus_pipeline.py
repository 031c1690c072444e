"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, tokens.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.

Every stage keeps rows with nulls as its operator defines it and takes empty tables; columns
beyond those of documents, whatever their names, pass through the first four stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.llm import bpe, mixing, near_copies, quality_rules, secrets, simhash
from inkweave.session import drop_folder, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host passes."""
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id: five-word shingles, a Jaccard similarity of 0.8."""
    return simhash.keep_first_of_group(docs, components=near_copies.jaccard_components)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.without_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the raked weights of sources, languages and topics."""
    return mixing.sampled_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the token ids of each document."""
    return bpe.token_lists(docs).select(F.col("id").alias("doc_id"), "n_tokens", "ids")


STAGES = [("quality rules", quality), ("simhash near-dedup", near_duplicates), ("secret scans", secret_scan), ("mixing", mixture), ("byte-level bpe", tokens)]

#: Fingerprints and token ids have no form in SQL; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents of sf_dir, each written to the session's shared folder and read again.

    What a stage has read is removed once it has written; the last one's input stays for its rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            drop_folder(spark, f"{base}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
