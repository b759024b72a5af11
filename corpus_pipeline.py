"""The corpus pipeline: documents through five operators, each stage on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with their
columns; the last returns their tokens. ``run`` applies them to the documents of a folder.
Between stages the documents are written to the shared folder as Parquet and read again; a
stage's table is removed when the next one is written.

Nulls, empty texts, repeated rows and extra columns have the results that the operators'
modules state; an empty table stays empty. Near-duplicate groups keep the document with the
least id, benchmark passages remove the documents that hold them, and personal data is
replaced within the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textlab.llm import bpe, decontam, minhash, pii, quality
from textlab.llm.common import drop_shared, materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return pii.replace_in(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens."""
    return bpe.encode(docs)


STAGES = [
    ("quality rules", good_quality),
    ("near-dedup", without_copies),
    ("decontamination", without_benchmark),
    ("personal data", with_surrogates),
    ("encoding", tokens),
]

#: SQL can't express the MinHash, edit distance, surrogate and encoding stages; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, old, kept = (done := materialize(docs, f"stage{k}")), kept, done
            if old is not None:
                drop_shared(old)
    return docs
