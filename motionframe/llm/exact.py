"""Exact duplicates by combining that no common text can hold up.

DataFrame functions only. Every task first deduplicates its own rows (the partial aggregate); what is left meets by digest, text and a salt that a
few tasks share; the salts' winners then meet by digest and text. Texts themselves are grouping keys at every stage, so two
texts are one only if all their bytes are. The answers travel back to the rows by digest, where a common digest's answer is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spread import lookup
from .storage import Scratch, table


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def sha512(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 512))


def _salt() -> Column:
    """A number that the tasks k*k to (k+1)*(k+1)-1 share, so that neither a salt's tasks nor the salts grow faster than the square root of the tasks."""
    return F.floor(F.sqrt(F.spark_partition_id()))


def combine(docs: DataFrame, digest: Callable[[Column], Column], winner: Column) -> DataFrame:
    """``key, text, winner, n``: every distinct text of ``docs`` (``text`` not null) with its greatest ``winner`` and its rows, dealt by the digest ``key``."""
    local = docs.select(_salt().alias("salt"), digest(F.col("text")).alias("key"), "text", winner.alias("winner"))
    merged = local.groupBy("salt", "key", "text").agg(F.max("winner").alias("winner"), F.count("*").alias("n"))
    return merged.repartition("key").groupBy("key", "text").agg(F.max("winner").alias("winner"), F.sum("n").alias("n"))


def classes(docs: DataFrame, digests: tuple[Callable[[Column], Column], ...] = (sha256, sha512)) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per row of ``docs``: the greatest doc_id of equal texts stays.

    Null texts are empty, and empty texts equal each other. Of rows that repeat both id and text one is kept. A null doc_id is less than any other;
    a group of null ids has a null keep_id and keeps one of its rows. Extra columns are ignored; an empty table gives no rows.

    Rows whose digest stands for two texts are told apart by the next of ``digests``; when the last one fails too, so does the job.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    return _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), digests, scratch)


def _classes(docs: DataFrame, digests: tuple[Callable[[Column], Column], ...], scratch: Scratch) -> DataFrame:
    digest, level = digests[0], str(len(digests))
    rows = docs.select("doc_id", digest(F.col("text")).alias("key"), sha256(F.col("text")).alias("sha"), F.monotonically_increasing_id().alias("tag"))
    rows = scratch.save(f"rows-{level}", rows)
    found = combine(docs, digest, F.col("doc_id")).groupBy("key").agg(F.count("*").alias("texts"), F.max("winner").alias("keep_id"), F.sum("n").alias("group_size"))
    groups = scratch.save(f"groups-{level}", found)
    best = rows.groupBy("key").agg(F.max(F.struct("doc_id", "tag"))["tag"].alias("best"))  # which of the rows that repeat the winner's id and text
    one = groups.where(F.col("texts") == 1).join(best, "key").drop("texts")
    shared = groups.where(F.col("texts") > 1).select("key")
    several = not shared.isEmpty()
    n = rows.count()
    plain = lookup(rows.join(shared, "key", "left_anti") if several else rows, one, "key", "group_size", n)
    out = plain.select("doc_id", "keep_id", "group_size", (F.col("tag") == F.col("best")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    if not several:
        return out
    if len(digests) == 1:
        raise ValueError("two texts share all digests")
    return out.unionByName(_classes(docs.withColumn("key", digest(F.col("text"))).join(shared, "key", "left_semi").select("doc_id", "text"), digests[1:], scratch))


def keep_one(docs: DataFrame) -> DataFrame:
    """The row with the greatest doc_id (null is least) of each group of equal texts, with all its columns (of types that have an order).

    Null texts are equal to empty ones. Of rows that share id and text the greatest by its columns in their order stays.
    """
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    return combine(whole, sha256, F.struct("doc_id", "_row")).select("winner._row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
