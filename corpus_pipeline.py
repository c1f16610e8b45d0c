"""From raw documents to packed training windows, stage by stage.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept, and returns a
DataFrame. All but the last return the columns of docs; column names that begin with __tidemark are the
stages' own. Rows that repeat are rows of their own. Every stage gives an empty table for an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, langid, mixing, near_dedup, packing
from tidemark.llm.common import copies_of, cut, documents


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that language identification rejects: null, without letters, or far from every learned language."""
    models = langid.fit_documents(docs.where(~langid.held_out()))
    kept = langid.with_language(docs, models)
    return kept.where(~F.col(langid.PREDICTED[2])).drop(*langid.PREDICTED)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of equal texts, that of the smallest doc_id (rows without one last). Null and empty texts are equal.

    Of rows alike in doc_id and text, the first in the order of all columns as JSON stays, here and below.
    """
    found = exact_dedup.exact_dedup(docs)
    return copies_of(docs, found.select("doc_id", "print", F.col("kept").cast("int").alias("copies")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, that of the smallest doc_id; texts without words all stay."""
    found = near_dedup.near_dedup(docs)
    return copies_of(docs, found.select("doc_id", "print", F.col("kept").cast("int").alias("copies")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix wants it; twice means two rows. A null source is a source; texts without words go."""
    return copies_of(docs, mixing.mix(docs).select("doc_id", "print", "copies"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens; a null text is its end mark alone."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The cube sample of the mixing stage has no SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each stage's rows written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
