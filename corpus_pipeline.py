"""A training corpus from documents: clean, deduplicate, redact, mix, encode.

Each stage is a function of (spark, docs, sf_dir); run() writes a stage's rows as Parquet in the folder the cluster shares and reads them
again as the next one's docs, after which what that stage had read goes. All but the last return the columns of documents.

Defined results: documents with null or empty texts are rejected by the quality rules (too few words); rows with null ids are never
duplicates of others and go on, redacted, mixed and encoded; of rows with one id the one with the smallest text stays; null languages and
sources are groups of their own in mixing; very long texts are read whole by every stage; further columns, whatever their names, are carried
up to the last stage; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, mixing, near_copies, pii, quality_rules
from skein.llm.tables import shared_folder

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None

MIX = mixing.Mix(budget_share=0.8, max_epochs=1, temperature=0.7, targets=mixing.TARGETS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents and failing lines go."""
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id. Links: similarity 0.8 or more on five-word shingles."""
    return near_copies.keep_one(docs, like=0.8, width=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans become the names of their kinds."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains, languages and sources at their target weights, at most one epoch of each, within a budget of tokens."""
    return mixing.mixed(docs, MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids)."""
    return bpe.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mix), ("encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark keeps it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
