"""Corpus pipeline: five stages over documents, each written as Parquet and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import queries as Q
from quarry.llm.common import dropped, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null, empty and short texts are such. Rows of an empty table: none."""
    return Q.keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays: that of the smallest doc_id, then fingerprint, then text hash. A row without an
    id stays only if its group has none with one. All texts without words are one group."""
    return Q.keep_representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts, which may become empty; n_chars follows. Null texts stay null; rows that
    repeat id and text are one document; a null id orders first."""
    return Q.cut_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a contaminated text go. Texts without words are clean, an empty benchmark leaves all."""
    return Q.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, one row for each row; a null or empty text has the begin and end ids alone."""
    return Q.encoded(docs)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("suffix_array_dedup", substring_dedup), ("decontamination", decontaminate), ("sentencepiece", encode)]

#: SQL can express neither SimHash (XXH64) nor the pieces of SentencePiece.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        kept = stored(made, name)
        for done in (made, docs):  # what it sent to the executors, and the stage before
            dropped(done)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
