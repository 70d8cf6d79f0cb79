"""From raw documents to token ids: five stages over the text operators.

Each stage reads what its predecessor kept and returns the columns of
documents; the last returns doc_id, source, n_tokens, ids and round_trip.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tillspark.llm import bpe, jaccard, mixing, quality, queries, secret_scan
from tillspark.session import drop, recording, shared_path

_scratch: list[str] = []


def tidy(step):
    """Drop what the stage before has left in the shared folder.

    A stage's result is written before the next stage begins, so the tables
    from which it was made are no longer read then.
    """
    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _scratch)
        with recording() as paths:
            out = step(spark, docs, sf_dir)
        _scratch.extend(paths)
        return out
    return run_step


@tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or whose host fails go."""
    return quality.keep_good(docs)


@tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return jaccard.keep_one(docs)


@tidy
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secret_scan.redact(docs)


@tidy
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


@tidy
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding."""
    return bpe.token_table(docs, queries.vocabulary_path())


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates),
          ("secrets", secrets), ("mixture", mixture), ("tokens", tokens)]

#: Minimum hashes, trained models and the vocabulary are beyond SQL; the stages
#: are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result stored for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        path = shared_path(spark, name)
        step(spark, docs, sf_dir).write.parquet(path)
        drop(spark, [docs_path] if name != STAGES[0][0] else [])
        docs, docs_path = spark.read.parquet(path), path
    drop(spark, _scratch)
    return docs
