"""Choosing, renaming and casting columns by list, type or table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# A column list read from a table goes into the plan, so it has to stay small.
MAX_LISTED_COLUMNS = 10_000


def select_cols(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.select(*cols)


def exclude_names(df: DataFrame, excluded: Iterable[str]) -> list[str]:
    skip = set(excluded)
    return [c for c in df.columns if c not in skip]


def select_exclude(df: DataFrame, excluded: Iterable[str]) -> DataFrame:
    return df.select(*exclude_names(df, excluded))


def names_by_type(df: DataFrame, kinds: tuple[type, ...] = (T.NumericType,)) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def select_by_dtype(df: DataFrame, kinds: tuple[type, ...] = (T.NumericType,)) -> DataFrame:
    return df.select(*names_by_type(df, kinds))


def names_from_table(table: DataFrame, column: str) -> list[str]:
    """Column names listed in a small table, e.g. the selected features."""
    rows = table.select(column).take(MAX_LISTED_COLUMNS + 1)
    if len(rows) > MAX_LISTED_COLUMNS:
        raise ValueError(f"more than {MAX_LISTED_COLUMNS} names listed in {column!r}")
    return [r[0] for r in rows]


def select_from_table(df: DataFrame, table: DataFrame, column: str = "feature",
                      keep: Iterable[str] = ()) -> DataFrame:
    return df.select(*keep, *names_from_table(table, column))


def existing_names(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in wanted if c in have]


def select_existing(df: DataFrame, wanted: Iterable[str],
                    context: Iterable[str] = ()) -> DataFrame:
    return df.select(*existing_names(df, dict.fromkeys([*wanted, *context])))


def drop_cols(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def rename_cols(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def with_column(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(columns))


def cast_cols(df: DataFrame, types: Mapping[str, str | T.DataType]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def pad_nulls(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` in the column order of ``like``, absent columns as typed nulls."""
    have = set(df.columns)
    return df.select(*[
        F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
        for f in like.schema.fields
    ])


def drop_null_rows(df: DataFrame, subset: Iterable[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(subset) if subset is not None else None)


def filter_slice(df: DataFrame, column: str = "sector", value: str = "Total") -> DataFrame:
    return df.where(F.col(column) == value)


def filter_entity(df: DataFrame, column: str, codes: Iterable) -> DataFrame:
    return df.where(F.col(column).isin(list(codes)))


def null_flags(df: DataFrame, cols: Iterable[str], suffix: str = "_is_null") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": F.col(c).isNull() for c in cols})


def union_by_name_pad(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name, columns absent on one side as null, then whole-row distinct."""
    return a.unionByName(b, allowMissingColumns=True).distinct()


def union_aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two tables with the same columns, then whole-row distinct."""
    return a.unionByName(b.select(*a.columns)).distinct()
