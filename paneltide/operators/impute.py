"""Filling nulls: rolling means, last and next values, column means and medians."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from paneltide.operators.ordered import (
    AFTER_ALL, BEFORE_ALL, carry_fill, entity_window, full_order, with_frames,
)
from paneltide.operators.stats import column_means, column_median
from paneltide.sources.io import stage_via_parquet
from paneltide.spec import PanelSpec


def rolling_mean_impute(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None = None,
                        preceding: int = 2) -> DataFrame:
    """A null becomes the mean of its frame (``preceding`` rows back to itself)."""
    cols = list(cols or spec.values(df))

    def build(w: WindowSpec) -> dict[str, Column]:
        frame = w.rowsBetween(-preceding, 0)
        return {c: F.coalesce(F.col(c), F.avg(c).over(frame)) for c in cols}

    return with_frames(df, spec, preceding, 0, build)


def rolling_mean_smooth(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None = None,
                        size: int = 3) -> DataFrame:
    """Every value becomes the mean of its last ``size`` rows; null until there are
    ``size`` values in the frame."""
    cols = list(cols or spec.values(df))

    def build(w: WindowSpec) -> dict[str, Column]:
        frame = w.rowsBetween(1 - size, 0)
        return {c: F.when(F.count(c).over(frame) == size, F.avg(c).over(frame)) for c in cols}

    return with_frames(df, spec, size - 1, 0, build)


def _entity_fill(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None,
                 forward: bool, backward: bool) -> DataFrame:
    cols = list(cols or spec.values(df))
    if spec.has_hot_entity(df):
        return carry_fill(df, full_order(df, spec), spec.entity, cols, forward, backward)
    up = entity_window(df, spec).rowsBetween(BEFORE_ALL, 0)
    if forward and backward:
        # What is still null after the forward fill lies before the first value.
        whole = entity_window(df, spec).rowsBetween(BEFORE_ALL, AFTER_ALL)
        new = {c: F.coalesce(F.last(c, True).over(up), F.first(c, True).over(whole)) for c in cols}
    elif forward:
        new = {c: F.last(c, True).over(up) for c in cols}
    else:
        # Descending order with a growing frame: one pass, where a frame that shrinks
        # towards the end would be evaluated anew for every row.
        down = entity_window(df, spec, descending=True).rowsBetween(BEFORE_ALL, 0)
        new = {c: F.last(c, True).over(down) for c in cols}
    return df.withColumns(new)


def forward_fill(df: DataFrame, spec: PanelSpec,
                 cols: Sequence[str] | None = None) -> DataFrame:
    return _entity_fill(df, spec, cols, True, False)


def backward_fill(df: DataFrame, spec: PanelSpec,
                  cols: Sequence[str] | None = None) -> DataFrame:
    return _entity_fill(df, spec, cols, False, True)


def fill_both(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None = None) -> DataFrame:
    """Forward fill, then backward fill of what is left, within each entity."""
    return _entity_fill(df, spec, cols, True, True)


def fill_across_entities(df: DataFrame, spec: PanelSpec,
                         cols: Sequence[str] | None = None) -> DataFrame:
    """Forward, then backward fill in (entity, time) order of the whole table, so that
    values cross from one entity to the next."""
    cols = list(cols or spec.values(df))
    return carry_fill(df, list(spec.cell), (), cols, True, True)


def fill_constants(df: DataFrame, values: Mapping[str, float | None]) -> DataFrame:
    """Replace the nulls of each column by one number."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast("double"))
                           for c, v in values.items()})


def fill_column_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return fill_constants(df, dict(column_means(df, cols).collect()))


def median_impute(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    return fill_constants(df, dict(column_median(df, cols, exact).collect()))


def impute_chain(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None = None,
                 across: bool = False, size: int = 3,
                 stage: Callable[[DataFrame], DataFrame] | None = stage_via_parquet) -> DataFrame:
    """Forward fill, backward fill, rolling mean, then the column mean.

    The column means need a second pass over the smoothed panel. ``stage`` materialises it
    in between, so that a large panel is shuffled once; with None it is computed twice.
    """
    cols = list(cols or spec.values(df))
    filled = fill_across_entities(df, spec, cols) if across else fill_both(df, spec, cols)
    smooth = rolling_mean_smooth(filled, spec, cols, size)
    if stage is not None:
        smooth = stage(smooth)
    return fill_column_means(smooth, cols)
