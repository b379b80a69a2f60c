"""The corpus pipeline: its stages over ``documents``, each reread from what the last one wrote.

Reject bad documents, keep one of each group of near copies, blot out secrets,
draw documents to target weights, and pack what is left into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import mixing, nearcopies, packing, quality, secrets
from cohortlens.llm.tables import table
from cohortlens.storage import materialise


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the classifier calls good; the others go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity of 0.8."""
    return nearcopies.keep_one(docs, words=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark."""
    return secrets.redacted(docs, secrets.train(secrets.labelled_samples(docs)))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics have their target shares of the tokens."""
    return mixing.sample(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences' pieces: which tokens of which document stand where."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("secret_scans", secret_scans),
    ("mixing_to_weights", mixing_to_weights),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: the stages train models and tokenize. Tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
