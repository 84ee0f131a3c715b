"""A corpus pipeline: five stages from raw documents to sampled encodings.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns the columns of
documents, but for the last. Its result is written as Parquet and read again as the next one's docs.

Defined cases: a null or empty text has no language and goes at the first stage, so the others see texts with a letter;
very long texts are worked on whole; repeated rows are near duplicates of each other, and one stays; null ids are rows
like any other, and the last to stand for a group; without labels every document scores a half and goes, with labels of
one class every document scores that class's share; an empty benchmark removes nothing; empty documents give no rows; columns beside those of documents,
whatever their names, come through all stages but the last, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trivalent.llm import golay_simhash, language_id, mil_quality, queries, sentencepiece_gumbel, suffix_decontam
from trivalent.llm.common import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without a letter go."""
    return language_id.keep_identified(docs, queries.language_profiles(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more."""
    return mil_quality.keep_good(docs, queries.quality_model(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id."""
    return golay_simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    return suffix_decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document, with their piece ids."""
    return sentencepiece_gumbel.sample(docs, queries.vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language),
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece_encoding", encoding),
]

#: The learned stages have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
