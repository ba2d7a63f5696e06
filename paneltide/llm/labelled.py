"""Labelled rows for fitting classifiers, kept to a documented bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents a classifier is fitted on, at most; a documented parameter of each fit.
MAX_LABELLED = 20_000


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def labelled_sample(labels: DataFrame, label: str, folds: int, held_out: int,
                    bound: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, label): at most ``bound`` labelled ids outside the held-out fold, by least hash.

    Null ids and labels are left out; an id labelled twice counts once, with its larger label.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
             .where(fold_of(F.col("doc_id"), folds) != held_out)
             .groupBy("doc_id").agg(F.max(label).cast("double").alias("label")))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
