"""A training corpus from raw documents: filter, deduplicate, mask, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again before the next stage.  All but the last return the columns of
their input, whatever these are; the last returns a row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import op2_ngram_join, op5_toxicity, op7_pii, op8_packing, op9_exact_dedup
from lorekeep.llm.common import materialise, table
from lorekeep.llm.word_tokens import default_path
from lorekeep.session import shipped

#: The stages learn, merge and pack: SQL cannot express the first.
ORACLE_SQL = None


@shipped
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity models score at the cut or above."""
    model = op5_toxicity.fit(docs, table(spark, sf_dir, "labels"), op5_toxicity.usable())
    return op5_toxicity.keep_clean(docs, model)


@shipped
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each text."""
    return op9_exact_dedup.keep_first(docs)


@shipped
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each component of near copies."""
    return op2_ngram_join.keep_first(docs)


@shipped
def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts."""
    return op7_pii.redact(docs, op7_pii.fit(docs))


@shipped
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' pieces into sequences."""
    return op8_packing.pack(docs, default_path())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
