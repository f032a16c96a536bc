"""Shared scratch tables and input helpers of the corpus operators.

Intermediate results that several jobs read are written as Parquet below the
folder the cluster names in ``spark.checkpoint.dir`` (shared by driver and
executors), so a lost executor costs a re-read, never a wrong answer.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder that ``spark.checkpoint.dir`` names. Unset, only a session in local mode gets a temporary one (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="motionframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


class Scratch:
    """Named Parquet tables of one operator run, droppable when no later job reads them."""

    def __init__(self, spark: SparkSession, owner: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{owner}-{uuid.uuid4().hex}"
        self.saved: set[str] = set()

    def save(self, name: str, df: DataFrame, *partition_by: str) -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        self.saved.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*(self.saved - set(names)))

    def drop(self, *names: str) -> None:
        self.saved -= set(names)
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with null texts as empty ones; every other column is left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fold(doc_id: str, parts: int = 5):
    """crc32 of the id's decimal text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def pieces_for(df: DataFrame, column: str, per_piece: int) -> int:
    """How many pieces of about ``per_piece`` bytes of ``column`` the whole table makes."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, -(-int(total) // per_piece))
