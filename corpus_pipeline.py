"""The pipeline over `documents`: five stages, each written as Parquet and read again.

SQL cannot express the stages; tests/llm/test_pipeline.py follows them by brute force.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from witspark.llm import bpe, fertility, jaccard, leaks, zquality
from witspark.llm.common import table
from witspark.plans.lineage import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the fertility bands go."""

    path = public_tokenizers.path("piece_bpe_32k.model")
    return fertility.judge(docs, path, rows=True).filter("kept").select("row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 1/2 go; learnt from the labels of this stage's input."""

    model = zquality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return zquality.score(docs, model, rows=True).filter("score >= 0.5").select("row.*")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""

    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""

    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_unpacked(docs, path, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
