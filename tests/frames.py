"""Small hand-made panels and plain-Python answers to compare with."""

from __future__ import annotations

import datetime as dt

from paneltide.spec import PanelSpec

SPEC = PanelSpec(cells_unique=True)
MEASURED = PanelSpec()

SCHEMA = ("id bigint, state_name string, state_code int, district_name string, "
          "district_code int, subdistrict_name string, subdistrict_code int, "
          "sector string, date date, a double, b int")


def month(n: int) -> dt.date:
    """The n-th month from January 2017."""
    return dt.date(2017 + n // 12, n % 12 + 1, 1)


def row(entity: int, n: int, a, b=1, district: int = 1, sector: str = "Total"):
    return (entity * 1000 + n, "S", 1, f"D{district}", district, f"E{entity}", entity,
            sector, month(n), a, b)


def panel(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def table(df, *cols):
    """Rows as a set-like sorted list of tuples."""
    got = [tuple(r) for r in df.select(*cols).collect()]
    return sorted(got, key=lambda t: tuple((v is None, v if v is not None else 0) for v in t))
