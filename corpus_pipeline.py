"""A corpus from raw documents: quality rules, line dedup, near-dedup, decontamination, token ids.

Each stage takes all the documents that the one before kept; all but the last return documents again, and what a stage
decides takes effect: rejected, duplicate and contaminated documents go, and so do the deleted lines of a text
(n_chars follows). A document of which line dedup leaves no line is gone too.

Nulls: a null or empty text has no words, so the quality rules reject it; a null doc_id, lang or source stays as it is, a document with a null doc_id
is the last of its copies to be kept. Rows that repeat a document leave one row, by near-dedup. Very long texts are taken whole by every stage. Empty tables give empty results of the
same columns. Columns beyond those of documents, whatever their names, pass through all stages but the last; names that start with __tm_ are the stages' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm import decontaminate, linededup, pieces, quality, similar
from threadmill.llm.common import materialize, plain, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_unrepetitive(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; those with nothing left go."""
    left = linededup.without_later_copies(docs).where((F.col("__tm_kept") > 0) | (F.col("__tm_lines") == 0))
    return left.withColumn("n_chars", F.when(F.col("__tm_kept") < F.col("__tm_lines"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*(F.col(plain(c)) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: a similarity of 0.8 or more on shingles of five words."""
    return similar.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each document the number of its ids, and the digests of ids and decoded text."""
    return pieces.digests(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: Near-dedup's shingle sets and the token ids have no SQL; a brute-force version checks run() in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{k}")
    return docs
