"""Dates: parsing, parts, labels, period flags and splits."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Date formats met in the input files, and the flagged period
# (year, first month, last month).
DATE_FORMATS = ("dd-MM-yyyy", "yyyy-MM-dd")
TIMESTAMP_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
                     "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
COVID_PERIODS = ((2020, 1, 9),)


def parse_date(c: str | Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Text to date by the first format that fits; null if none does."""
    text = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def parse_timestamp(c: str | Column, formats: Sequence[str] = TIMESTAMP_FORMATS) -> Column:
    text = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*[
        F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats
    ])


def date_parts(df: DataFrame, column: str = "date") -> DataFrame:
    return df.withColumns({"year": F.year(column), "month": F.month(column)})


def year_month_label(year: str = "year", month: str = "month") -> Column:
    """``2020-3``: month without leading zero. For a sortable label use date_format."""
    return F.concat_ws("-", F.col(year).cast("string"), F.col(month).cast("string"))


def in_periods(column: str, periods: Sequence[tuple[int, int, int]]) -> Column:
    """True inside any (year, first month, last month) period."""
    hit = F.lit(False)
    for year, first, last in periods:
        hit = hit | ((F.year(column) == year) & F.month(column).between(first, last))
    return hit


def flag_period(df: DataFrame, column: str = "date",
                periods: Sequence[tuple[int, int, int]] = COVID_PERIODS,
                name: str = "is_covid_period") -> DataFrame:
    return df.withColumn(name, F.when(in_periods(column, periods), 1).otherwise(0))


def filter_date(df: DataFrame, day: dt.date, column: str = "date") -> DataFrame:
    return df.where(F.col(column) == F.lit(day))


def period_of(column: str = "date",
              period: tuple[int, int, int] = COVID_PERIODS[0]) -> Column:
    """``before``, ``during`` or ``after`` the period."""
    year, first, last = period
    start = dt.date(year, first, 1)
    end = dt.date(year + last // 12, last % 12 + 1, 1)
    return (F.when(F.col(column) < F.lit(start), "before")
             .when(F.col(column) < F.lit(end), "during")
             .otherwise("after"))


def split_periods(df: DataFrame, column: str = "date",
                  period: tuple[int, int, int] = COVID_PERIODS[0]
                  ) -> tuple[DataFrame, DataFrame]:
    """Rows before the period and rows after it."""
    where = period_of(column, period)
    return df.where(where == "before"), df.where(where == "after")


def split_by_date(df: DataFrame, train_end: dt.date, val_end: dt.date,
                  column: str = "date", name: str = "split") -> DataFrame:
    """Label each row train (to train_end), val (to val_end) or test (later)."""
    day = F.col(column)
    return df.withColumn(name, F.when(day <= F.lit(train_end), "train")
                               .when(day <= F.lit(val_end), "val")
                               .when(day > F.lit(val_end), "test"))
