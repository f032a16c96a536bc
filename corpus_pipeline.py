"""From raw documents to packed training sequences: toxicity, near-duplicates, repeated strings, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motionframe.llm import packing, simhash, suffix, toxicity
from motionframe.llm.storage import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from ``labels``, does not reject; repeated rows are judged alike, null texts as empty ones."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the smallest doc_id (null last), then the smallest text digest. Null texts are empty ones."""
    return simhash.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that a document with a smaller id has; documents with nothing left go."""
    return suffix.cut_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all token pieces in sequences; a null or empty text is its end token, repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("suffix_array", drop_repeats), ("packing", pack)]

#: No stage can be stated in SQL; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread by the next; an empty table goes through to no rows.

    A stage's table is dropped when the next one is written; the last one stays, for the result reads it.
    """
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(name, stage(spark, docs, sf_dir))
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
