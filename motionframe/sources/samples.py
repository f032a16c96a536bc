"""Labelled feature tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import require


def write_samples(samples: DataFrame, path: str, *partition_by: str) -> None:
    """``features, label`` (and keys) as Parquet, by channel or frame where asked."""
    writer = require(samples, "features", "label").write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return require(spark.read.parquet(path), "features", "label")


def write_table(rows: DataFrame, path: str, kind: StructType, *partition_by: str) -> None:
    """``rows`` as Parquet with the columns and types of ``kind`` (``schema.FIELDS`` and its like); columns that it lacks are an error."""
    typed = require(rows, *kind.names).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kind])
    writer = typed.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_table(spark: SparkSession, path: str, kind: StructType) -> DataFrame:
    return require(spark.read.parquet(path), *kind.names).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kind])
