"""From raw documents to packed training sequences: quality, exact dedup, near-duplicate removal, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run`` writes each stage's result
to the shared folder and reads it again for the next one. SQL can't express the classifier or the packing, so there is no
oracle; tests/llm/test_pipeline.py tests the stages against brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import exact_dedup, ngram_join, packing, pii, quality
from weftgraph.llm.common import Scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, taught by the labelled documents that aren't held out, doesn't reject."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links by five-word shingles at a Jaccard similarity of 0.8."""
    return ngram_join.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids (little-endian unsigned 32-bit integers), packed into sequences of
    at most 1024 tokens: a sequence is its pieces' ids in the order of their offsets."""
    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)
    return pieces.select(
        F.col("id").alias("doc_id"), "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"
    )


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("ngram_jaccard", without_near_copies),
    ("pii", without_personal_data),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
