"""A corpus pipeline: quality rules, near-duplicates, personal data, mixing, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from orbitweave.llm.bpe import encoded_digests
from orbitweave.llm.mixing import mixed
from orbitweave.llm.pii import masked
from orbitweave.llm.quality_rules import cleaned_documents
from orbitweave.llm.simhash import keep_one
from orbitweave.session import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents, and takes the lines above their host's limit out of the others.

    Null texts count as empty and are rejected; repeated rows are judged alike; an empty table gives no rows. All stages
    pass columns of any name on.
    """
    return cleaned_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component; rows without an id only where it has no other. An empty table gives no rows."""
    return keep_one(docs)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data as their kinds in brackets; all rows stay, null texts as they are."""
    return masked(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings the shares of toxic and poor text down; sound documents all stay, some rows may come more than once."""
    return mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), whole="sound")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests by row: doc_id, n_tokens, ids_sha256, decoded_sha256; null texts count as empty."""
    return encoded_digests(docs)


STAGES = [("quality rules", quality), ("near-duplicates", near_dedup), ("personal data", personal), ("mixing", mixing), ("tokens", tokens)]
#: The stages hash, iterate and merge, which SQL can't express; the tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again by the next."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
