"""The corpus pipeline: five stages, each one training-data operator over all that the stage before has kept.

1. language ID: documents without a letter, or whose best language has under
   half of the weight, go;
2. line dedup: repeated lines go, and with them documents of which nothing is
   left;
3. n-gram Jaccard join: of each group of near copies one document stays;
4. benchmark decontamination: documents that hold a benchmark item go;
5. SentencePiece encoding: the documents' ids.

All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, jaccard_join, langid, line_dedup, piece_dropout
from graphloom.llm.common import fresh, stage, table

#: Share of the weight that a document's language has at least.
LANGUAGE_SHARE = 0.5
#: Near copies: five-word shingles, similarity in per cent.
NEAR_WIDTH, NEAR_LEAST = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with at least ``LANGUAGE_SHARE`` of the weight; null texts and those without a letter go."""
    pred, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "lang_score")
    named = langid.identify(docs, langid.learn(docs), pred, score)
    return named.where((F.col(pred) != langid.UNKNOWN) & (F.col(score) >= LANGUAGE_SHARE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat others; those that lost lines and have no letter or digit left go."""
    out = line_dedup.dedup_lines(docs)
    gone = out.columns[-1]
    return out.where((F.col(gone) == 0) | F.col("text").rlike(r"[\p{L}\p{N}]")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities over ``NEAR_WIDTH``-word shingles join."""
    return jaccard_join.keep_one(docs, NEAR_WIDTH, NEAR_LEAST)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, by merge-dropout."""
    return piece_dropout.encode_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("jaccard_join", near_copies),
    ("decontamination", decontamination),
    ("piece_dropout", encode),
]

#: No SQL expresses the automata, fingerprints and merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
