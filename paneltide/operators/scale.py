"""Scaling with statistics fitted on one table and applied to another.

Fitting is one aggregate whose result, a few numbers per column, comes to the driver; the
scaled table is then a plain projection with constants.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F

from paneltide.operators.stats import per_column


def _apply(df: DataFrame, fit_on: DataFrame, cols: Sequence[str],
           stats: dict[str, Callable[[str], Column]],
           scaled: Callable[[Column, Row], Column]) -> DataFrame:
    fitted = {r.feature: r for r in per_column(fit_on, cols, stats).collect()}
    return df.withColumns({c: scaled(F.col(c).cast("double"), fitted[c]) for c in cols})


def standard_scale(df: DataFrame, cols: Sequence[str],
                   fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0."""
    return _apply(df, df if fit_on is None else fit_on, cols,
                  {"mean": F.avg, "std": F.stddev_pop},
                  lambda x, s: (x - F.lit(s.mean)) / F.lit(s.std or 1.0))


def minmax_scale(df: DataFrame, cols: Sequence[str],
                 fit_on: DataFrame | None = None) -> DataFrame:
    """(x - min) / (max - min) of the fitted table, not clipped; range 0 divides by 1."""
    return _apply(df, df if fit_on is None else fit_on, cols,
                  {"low": lambda c: F.min(c).cast("double"),
                   "high": lambda c: F.max(c).cast("double")},
                  lambda x, s: (x - F.lit(s.low)) / F.lit(_spread(s)))


def _spread(s: Row) -> float | None:
    return None if s.low is None else (s.high - s.low) or 1.0
