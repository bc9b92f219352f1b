"""Corpus pipeline: documents through five of the training-data operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet in the shared folder and reread as the next stage's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidings.llm import decontamination, language_id, quality_rules, sentencepiece_lattice, simhash
from tidings.llm.common import table, written
from tidings.llm.queries import PIECE_MODEL, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the log-likelihood ratio go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or with a narrow margin between languages go."""
    return language_id.keep_identified(docs, language_id.dictionaries(docs.where(~language_id.held_out())))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left."""
    return sentencepiece_lattice.encode(docs, tokenizer_path(PIECE_MODEL))


STAGES = [("quality rules", quality), ("language ID", language), ("SimHash near-dedup", near_dedup),
          ("benchmark decontamination", decontaminate), ("SentencePiece encoding", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs


# compression sizes, log-ratios and merges cannot be said in SQL; the tests hold run() against brute force
ORACLE_SQL = None
