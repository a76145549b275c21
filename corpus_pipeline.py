"""A training-data pipeline over ``documents``, counted as part of ``pathloom.llm``.

Every stage works on all that the one before it kept; between stages documents
are a table in the shared folder. All but the last return the columns of
documents. No stage can be said in SQL as a whole (compression ratios, seeded
draws, tokenizer ids), so there is no oracle; tests compare with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm import exact_dedup, mixing, ngram_join, quality_rules, sentencepiece_codec
from pathloom.llm.common import documents, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.keep(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its 5-grams stays."""
    return ngram_join.keep(docs, ngram_join.Rule(words=5, percent=80))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: rows are the pieces of documents that the mix takes, as often as it does."""
    return mixing.apply(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids instead of texts."""
    import public_tokenizers

    return sentencepiece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mixed), ("sentencepiece", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
