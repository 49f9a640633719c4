"""The corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir), works on all that the one before it has kept, and is written as Parquet before
the next one reads it. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm.common import materialize, table
from veilscan.llm.credential_scan import redact_secrets
from veilscan.llm.decontamination import find_leaks
from veilscan.llm.near_duplicates import drop_duplicates
from veilscan.llm.pieces import encode_documents
from veilscan.llm.quality_classifier import learn, score_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 1/2 or more stay; the classifier is fitted on the labelled ones among them."""
    machine = learn(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, machine, out="_score").where("_score >= 0.5").drop("_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the least doc_id."""
    return drop_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return find_leaks(docs, table(spark, sf_dir, "benchmark"), out="_leaks").where(F.size("_leaks") == 0).drop("_leaks")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are replaced, and n_chars follows."""
    return redact_secrets(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, in a row for each chunk of it."""
    parts = encode_documents(docs.select("doc_id", "text"))
    return parts.select("doc_id", "chunk", "first", "n_tokens", "exact", "ids")


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scan", secrets),
    ("piece encoding", encoding),
]

#: The classifier, the sampling and the encoding are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{i}-{name.replace(' ', '-')}")
    return docs
