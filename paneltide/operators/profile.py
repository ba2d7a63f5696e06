"""Column profile: types, counts, distinct values, bounds, histogram, top values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from paneltide.operators.stats import MAX_WIDE_COLUMNS, describe_table


def _is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, number, text, n): how often each value of each column occurs.

    The count is combined map-side, so a frequent value costs one row per task.
    """
    values = F.array(*[
        F.struct(F.lit(c).alias("feature"),
                 (F.col(c).cast("double") if _is_numeric(df, c)
                  else F.lit(None).cast("double")).alias("number"),
                 (F.lit(None).cast("string") if _is_numeric(df, c)
                  else F.col(c).cast("string")).alias("text"))
        for c in cols])
    return (df.select(F.inline(values))
              .where(F.col("number").isNotNull() | F.col("text").isNotNull())
              .groupBy("feature", "number", "text").agg(F.count(F.lit(1)).alias("n")))


def _distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, d): the exact number of distinct values of each column.

    A few columns are counted one by one, each read alone and in its own type; many, in long form.
    """
    if len(cols) > MAX_WIDE_COLUMNS:
        return value_counts(df, cols).groupBy("feature").agg(F.count(F.lit(1)).alias("d"))
    parts = []
    for c in cols:
        value = F.col(c).cast("double" if _is_numeric(df, c) else "string").alias("v")
        values = df.select(value).where(F.col("v").isNotNull()).groupBy("v").agg(F.lit(1))
        parts.append(values.agg(F.count(F.lit(1)).alias("d")).select(F.lit(c).alias("feature"), "d"))
    return reduce(DataFrame.unionByName, parts)


def column_profile(df: DataFrame, cols: Sequence[str] | None = None,
                   exact: bool = True) -> DataFrame:
    """One row per column: type, count, missing, distinct, zeros, bounds, moments,
    quartiles. With ``exact=False`` distinct counts and quartiles are sketches."""
    cols = list(cols or df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    base = describe_table(df, cols, exact)

    def lookup(row: DataFrame) -> Column:
        return F.try_element_at(row.scalar(), F.col("feature"))

    names = F.array(*[F.lit(c) for c in cols])
    zeros = df.agg(F.map_from_arrays(names, F.array(*[
        F.count_if(F.col(c) == 0) if _is_numeric(df, c) else F.count_if(F.lit(False))
        for c in cols])))
    if exact:
        distinct = _distinct_counts(df, cols).agg(F.map_from_entries(F.collect_list(F.struct("feature", "d"))))
    else:
        distinct = df.agg(F.map_from_arrays(names, F.array(*[
            F.approx_count_distinct(c) for c in cols])))
    return base.select(
        "feature",
        F.element_at(F.create_map(*[F.lit(x) for c in cols for x in (c, types[c])]),
                     F.col("feature")).alias("type"),
        "count", F.col("nulls").alias("missing"),
        F.coalesce(lookup(distinct), F.lit(0)).alias("distinct"),
        lookup(zeros).alias("zeros"),
        "mean", "std", "min", "max", "min_text", "max_text", "q25", "q50", "q75")


def column_histogram(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """(feature, bin, low, high, n) over equal widths between the column's bounds."""
    bounds = df.agg(F.struct(*[
        F.struct(F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"))
         .alias(c) for c in cols])).scalar()
    with_bounds = df.select(*cols, bounds.alias("__b"))

    def entry(c: str) -> Column:
        low, high = F.col("__b")[c]["low"], F.col("__b")[c]["high"]
        width = F.when(high > low, high - low).otherwise(1.0)
        place = F.floor((F.col(c).cast("double") - low) / width * bins)
        # when, not least: least would skip a null and put it in the last bin.
        return F.struct(F.lit(c).alias("feature"),
                        F.when(place >= bins, bins - 1).otherwise(place).cast("int").alias("bin"),
                        low.alias("__low"), high.alias("__high"))

    counted = (with_bounds.select(F.inline(F.array(*[entry(c) for c in cols])))
               .where(F.col("bin").isNotNull())
               .groupBy("feature", "bin", "__low", "__high").agg(F.count(F.lit(1)).alias("n")))
    step = (F.col("__high") - F.col("__low")) / bins
    return counted.select("feature", "bin",
                          (F.col("__low") + step * F.col("bin")).alias("low"),
                          (F.col("__low") + step * (F.col("bin") + 1)).alias("high"), "n")


def column_top_values(df: DataFrame, cols: Sequence[str], top: int = 5) -> DataFrame:
    """The most frequent values of each column; ties by value.

    The rank filter is applied before the shuffle as well, so a column with many
    distinct values sends ``top`` rows per task.
    """
    rank = F.row_number().over(
        Window.partitionBy("feature").orderBy(F.desc("n"), "number", "text"))
    return value_counts(df, cols).withColumn("rank", rank).where(F.col("rank") <= top)


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Number of rows that repeat an earlier row, and of distinct repeated rows."""
    cols = list(cols or df.columns)
    copies = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_rows"),
        F.count_if(F.col("n") > 1).alias("repeated_values"))

