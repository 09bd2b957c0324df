"""A corpus pipeline of five operators: language, near-duplicates, benchmark passages, personal data, mixing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which run() writes as Parquet and reads again as the next stage's docs. All stages but the last
return the columns of documents. The last returns, for the documents of which the mix takes words, the
same columns, whose text holds the taken words alone, as often as they are taken, besides size
(words before), source_size, target and taken (words of the new text).

Cases are those of the operators: documents without a language go in the first stage; null and
repeated doc_ids are handled by rows; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.llm import op2_language, op4_pii, op7_decontamination, op8_mixing, op10_minhash
from latticework.llm.common import cut, table

#: Documents whose mean probability of the best language is lower are rejected.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or with no language more probable than not."""
    return op2_language.accepted(docs, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a similarity of 0.8 of five-word shingles."""
    return op10_minhash.keep_one(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return op7_decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts; keeps all documents."""
    return op4_pii.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes words of documents by the sources' weights; texts hold what is taken, repeats included."""
    return op8_mixing.remade(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]
#: Language ID, near-duplicates and bootstrapping are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
