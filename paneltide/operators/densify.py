"""Completing the months of a panel.

Months are a calendar, so a list of them is a small array. Entities are expanded by
``explode`` of that array and gaps are found with ``array_except`` per entity; no grid
is built and nothing is joined.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from paneltide.functions.columns import pad_nulls
from paneltide.spec import PanelSpec

MONTH = "interval 1 month"


def distinct_entities(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.select(*spec.attrs).distinct()


def _attributes(spec: PanelSpec) -> list[str]:
    return list(dict.fromkeys([*spec.entity, *spec.attrs]))


def latest_entities(df: DataFrame, spec: PanelSpec, *more: Column) -> DataFrame:
    """One row per entity with its attributes at its last month, e.g. after a change of name.

    Among rows of that month the largest values count, taken together.
    """
    rest = [c for c in _attributes(spec) if c not in spec.entity]
    last = F.max(F.struct(spec.time, *rest)).alias("__last")
    return df.groupBy(*spec.entity).agg(last, *more).select(
        *spec.entity, *[F.col("__last")[c].alias(c) for c in rest],
        *[c for c in ("__have",) if more])


def distinct_dates(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.select(spec.time).distinct().orderBy(spec.time)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def date_bounds(df: DataFrame, column: str = "date") -> DataFrame:
    return df.agg(F.min(column).alias("min_date"), F.max(column).alias("max_date"))


def _axis_array(df: DataFrame, column: str) -> DataFrame:
    return date_bounds(df, column).select(
        F.sequence("min_date", "max_date", F.expr(MONTH)).alias("months"))


def date_axis(df: DataFrame, column: str = "date") -> DataFrame:
    """Every month from the first to the last date of ``df``."""
    return _axis_array(df, column).select(F.explode("months").alias(column))


def missing_months_global(df: DataFrame, column: str = "date") -> DataFrame:
    """Months of the axis in which no row of the table falls."""
    present = df.select(column).distinct()
    return date_axis(df, column).join(present, column, "left_anti")


def as_array(months: DataFrame | Sequence[dt.date], column: str = "date") -> Column:
    """A calendar as one array value: a literal, or a scalar subquery over a table."""
    if isinstance(months, DataFrame):
        return months.agg(F.array_sort(F.collect_set(column))).scalar()
    return F.array(*[F.lit(d) for d in months]).cast("array<date>")


def cross_entities_dates(entities: DataFrame, months: DataFrame | Sequence[dt.date],
                         column: str = "date") -> DataFrame:
    """Every entity with every listed month."""
    return entities.select("*", F.explode(as_array(months, column)).alias(column))


def _absent_cells(df: DataFrame, spec: PanelSpec, months: Column) -> DataFrame:
    """(entity attributes, month) cells of ``months`` that ``df`` does not hold.

    The set per entity holds distinct months only, however many rows the entity has.
    """
    present = latest_entities(df, spec, F.collect_set(spec.time).alias("__have"))
    return present.select(
        *_attributes(spec),
        F.explode(F.array_except(months, F.col("__have"))).alias(spec.time))


def missing_months_per_entity(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return _absent_cells(df, spec, _axis_array(df, spec.time).scalar())


def _append(df: DataFrame, cells: DataFrame, spec: PanelSpec,
            slice_value: str | None) -> DataFrame:
    if slice_value is not None:
        cells = cells.withColumn(spec.slice_col, F.lit(slice_value))
    return df.unionByName(pad_nulls(cells, df))


def densify_listed(df: DataFrame, spec: PanelSpec, months: Sequence[dt.date],
                   slice_value: str | None = None, mode: str = "absent") -> DataFrame:
    """Add the listed months to every entity.

    ``absent`` adds only cells the entity lacks. ``union_distinct`` adds every listed
    cell and drops rows that are equal as a whole: a cell that existed then has two
    rows, so the result no longer has unique cells.
    """
    if mode == "absent":
        cells = _absent_cells(df, spec, as_array(months, spec.time))
        return _append(df, cells, spec, slice_value)
    if mode == "union_distinct":
        cells = cross_entities_dates(distinct_entities(df, spec), months, spec.time)
        return _append(df, cells, spec, slice_value).distinct()
    raise ValueError(f"unknown mode {mode!r}")


def densify_missing(df: DataFrame, spec: PanelSpec,
                    slice_value: str | None = None) -> DataFrame:
    """Add the months that the whole table lacks to every entity."""
    missing = missing_months_global(df, spec.time)
    cells = cross_entities_dates(latest_entities(df, spec), missing, spec.time)
    return _append(df, cells, spec, slice_value)


def densify_full(df: DataFrame, spec: PanelSpec,
                 slice_value: str | None = None) -> DataFrame:
    """Complete (entity x month) grid from the first to the last month of the table."""
    return _append(df, missing_months_per_entity(df, spec), spec, slice_value)
