"""Readers, writers and staging between steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from paneltide.session import stage_path


def scan_csv(spark: SparkSession, path: str,
             schema: T.StructType | str | None = None) -> DataFrame:
    """Header CSV. With a schema the file is read once; inference reads it twice."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def literal_rows(spark: SparkSession, rows: Sequence[tuple],
                 schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


def sink_csv_single(df: DataFrame, path: str, order: Sequence[str],
                    mode: str = "overwrite", single: bool = True) -> None:
    """A sorted CSV report: one file, for which all rows pass through one task.

    Call it with ``single=False`` for a table too large for that: it gets files sorted by
    range, which give the same rows in the same order when read by name.
    """
    # repartition, not coalesce: the work before it stays parallel.
    out = df.repartition(1).sortWithinPartitions(*order) if single else df.orderBy(*order)
    out.write.mode(mode).csv(path, header=True)


def sink_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                 mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path, partitionBy=list(partition_by) or None)


def stage_via_parquet(df: DataFrame, path: str | None = None,
                      csv_path: str | None = None) -> DataFrame:
    """Write Parquet once and go on from the file; optionally export it as CSV."""
    spark = df.sparkSession
    path = path or stage_path(spark, "table")
    df.write.mode("overwrite").parquet(path)
    staged = spark.read.parquet(path)
    if csv_path is not None:
        sink_csv(staged, csv_path)
    return staged


def cache_stage(df: DataFrame) -> DataFrame:
    """Keep ``df`` for reuse; the caller unpersists it."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
