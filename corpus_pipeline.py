"""A training-corpus pipeline over ``documents``: five operators, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treelens.llm import decontam, langid, mixing, neardup, pii
from treelens.llm.common import save, table


#: A document's language holds so much of its letters at least, and so many of its n-grams are known.
MIN_SCORE, MIN_KNOWN = 0.5, 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without an identifiable language: no main language, a script or n-grams that no language has."""
    return langid.keep_identified(docs, langid.fit(docs), MIN_SCORE, MIN_KNOWN)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: five-word shingles, similarity 0.8 or more."""
    return neardup.drop_near_duplicates(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark passage."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by placeholders."""
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, each with ``taken``: its words in the mix, taken / size times over.

    Adds size, source_size, target and taken; a document of which nothing is taken goes.
    """
    return mixing.mix_documents(docs).where("taken > 0")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii_redaction", pii_redaction),
    ("source_mix", source_mix),
]

#: Trained models and banded alignment are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
