"""Work that grows with a month's delivery, not with the panel: carried rows and mergeable sketches.

A window that looks back k rows needs, of all earlier months, the last k rows of each entity. These
are the state: one small table, replaced month by month. Profiles keep sketches per month, which
merge, so that any run of months is profiled without reading its rows again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from paneltide.spec import PanelSpec

_NEW, _BACK = "__new", "__back"

#: Relative size of the distinct-value sketch (2 ** 12 registers: a standard error of 1.6 %), and of
#: the quantile sketch (rank errors of about 0.65 % at 400).
HLL_BITS = 12
KLL_SIZE = 400


def last_rows(df: DataFrame, spec: PanelSpec, rows: int) -> DataFrame:
    """The last ``rows`` rows of every entity: the state that later months need."""
    back = F.row_number().over(Window.partitionBy(*spec.entity).orderBy(F.desc(spec.time)))
    return df.withColumn(_BACK, back).where(F.col(_BACK) <= rows).drop(_BACK)


def with_month(state: DataFrame | None, month: DataFrame, spec: PanelSpec, rows: int,
               step: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(result, next state) of a delivery of later rows than all that came before.

    ``step`` is a window step that looks back at most ``rows`` rows, such as ``lag_features``; its
    result has the rows of ``month`` only and is what the step gives on the whole panel. Cells must
    be unique. The state holds at most ``rows`` rows of each entity; stage it before the next month.
    """
    new = month.withColumn(_NEW, F.lit(True))
    both = new if state is None else state.withColumn(_NEW, F.lit(False)).unionByName(new)
    result = step(both.drop(_NEW) if state is None else both)
    if state is not None:
        result = result.where(_NEW).drop(_NEW)
    return result, last_rows(both.drop(_NEW), spec, rows)


def fill_forward_month(state: DataFrame | None, month: DataFrame, spec: PanelSpec,
                       cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(filled rows of the month, next state) of a forward fill.

    The state is the last filled row of each entity; its values stand in where the month's rows
    start with nulls.
    """
    known = None if state is None else state.select(*spec.entity, *[F.col(c).alias(f"__{c}") for c in cols])
    order = Window.partitionBy(*spec.entity).orderBy(spec.time).rowsBetween(Window.unboundedPreceding, 0)
    filled = month.withColumns({c: F.last(c, ignorenulls=True).over(order) for c in cols})
    if known is not None:
        filled = filled.join(known, list(spec.entity), "left").withColumns(
            {c: F.coalesce(c, f"__{c}") for c in cols}).drop(*[f"__{c}" for c in cols])
    columns = [*spec.cell, *cols]
    last = filled.select(*columns) if state is None else state.select(*columns).unionByName(filled.select(*columns))
    return filled, last_rows(last, spec, 1)


def month_sketches(df: DataFrame, spec: PanelSpec, cols: Sequence[str]) -> DataFrame:
    """(month, feature, n, nulls, zeros, total, low, high, values_sketch, ranks_sketch): a month's profile
    of numeric columns, in one scan and one aggregate."""
    rows = df.select(F.trunc(F.col(spec.time).cast("date"), "MM").alias("month"), *cols)
    long = rows.select("month", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])))
    return long.groupBy("month", "feature").agg(
        F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("nulls"),
        F.count_if(F.col("x") == 0).alias("zeros"), F.sum("x").alias("total"),
        F.min("x").alias("low"), F.max("x").alias("high"),
        F.hll_sketch_agg(F.xxhash64("x"), HLL_BITS).alias("values_sketch"),
        F.kll_sketch_agg_double("x", KLL_SIZE).alias("ranks_sketch"))


def merged_profile(sketches: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """feature, n, nulls, zeros, mean, low, high, distinct (estimated) and q25, ... (estimated) of all
    months in ``sketches``, from their sketches alone."""
    sums = sketches.groupBy("feature").agg(
        *[F.sum(c).alias(c) for c in ("n", "nulls", "zeros")], F.sum("total").alias("total"),
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_sketch_estimate(F.hll_union_agg("values_sketch")).alias("distinct"),
        F.kll_merge_agg_double("ranks_sketch").alias("ranks"))
    at = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("ranks", F.lit(float(q)))).alias(f"q{round(100 * q)}")
          for q in quantiles]
    return sums.select("feature", "n", "nulls", "zeros", F.try_divide("total", "n").alias("mean"), "low", "high",
                       "distinct", *at)
