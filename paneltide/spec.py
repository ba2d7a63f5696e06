"""Which columns of a wide monthly panel play which role."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

# Column names of the input panel.
ENTITY_ATTRS = (
    "state_name", "state_code", "district_name", "district_code",
    "subdistrict_name", "subdistrict_code",
)
CONTEXT_COLS = ("year", "month", "is_covid_period")

# 12 months x 9,999 years: the most rows one entity can hold when each (entity, month)
# cell occurs once and the month is a DATE. Up to here one task may hold an entity.
MAX_ENTITY_ROWS = 119_988


@dataclass(frozen=True)
class PanelSpec:
    """Roles of the panel columns.

    ``cells_unique`` declares that no (entity, month) cell occurs twice, e.g. because the
    panel is the result of a groupBy on that cell. Without it the operators measure the
    largest entity before they choose how to partition an ordered window.
    """

    entity: tuple[str, ...] = ("subdistrict_code",)
    group: tuple[str, ...] = ("district_code",)
    time: str = "date"
    attrs: tuple[str, ...] = ENTITY_ATTRS
    slice_col: str = "sector"
    row_id: str = "id"
    context: tuple[str, ...] = CONTEXT_COLS
    cells_unique: bool = False

    @property
    def identifiers(self) -> tuple[str, ...]:
        named = (self.row_id, *self.attrs, *self.entity, *self.group,
                 self.slice_col, self.time, *self.context)
        return tuple(dict.fromkeys(named))

    @property
    def cell(self) -> tuple[str, ...]:
        return (*self.entity, self.time)

    def values(self, df: DataFrame) -> list[str]:
        """Indicators: numeric columns that are not identifiers."""
        skip = set(self.identifiers)
        return [f.name for f in df.schema.fields
                if f.name not in skip and isinstance(f.dataType, T.NumericType)]

    def has_hot_entity(self, df: DataFrame) -> bool:
        """True if some entity holds more rows than one task should sort.

        Reads the entity column only; the counts are combined map-side.
        """
        if self.cells_unique:
            return False
        counts = df.groupBy(*self.entity).agg(F.count(F.lit(1)).alias("n"))
        return not counts.where(F.col("n") > MAX_ENTITY_ROWS).isEmpty()
