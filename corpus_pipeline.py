"""A corpus cleaning pipeline over ``documents``: five stages, each one of the llm operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns they were given; the last returns every document of the mix
once per copy, with the copy's number.

Defined cases, in every stage: an empty table gives an empty one; extra columns, also with names
used inside the operators, are kept as they are; very long texts are taken whole. Null text: language
identification rejects it, as it does empty text and text without a letter, so the later stages see
neither from here; given alone, they keep such rows, and the mix takes none of them. Rows without a
doc_id are documents like others. Repeated rows: the near-duplicate stage keeps one of those with an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matstream.llm import decontam, langid, mixing, neardup, pii
from matstream.llm.common import materialise, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go."""
    return langid.keep_identified(docs)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", neardup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: stages with trained models and sketches cannot be written in SQL; tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result goes through the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
