"""Reading the input tables and small helpers that every operator of this package shares."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str, columns: Iterable[str]) -> DataFrame:
    """The asked columns of one input table; any others, clashing names included, stay out."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. Plain ``lower`` gives the same where all is ASCII."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_key() -> Column:
    """A hash of the text: with the doc_id it tells rows apart that share an id."""
    return F.xxhash64("text").alias("text_key")


#: Row keys are broadcast up to this many (some 20 MB), else joined by a shuffle.
BROADCAST_KEYS = 200_000


def by_row(docs: DataFrame, decided: DataFrame, how: str) -> DataFrame:
    """Join ``docs`` with rows (doc_id, text_key, ...) decided on, an empty or null id included.

    ``how`` is left_anti, left_semi or left. Texts are shuffled only where the decided rows are
    too many for a broadcast.
    """
    few = decided.count() <= BROADCAST_KEYS
    right = decided.withColumnsRenamed({"doc_id": "_doc_id", "text_key": "_text_key"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.xxhash64("text") == F.col("_text_key"))
    return docs.join(F.broadcast(right) if few else right, same, how)
