"""Sliding windows over the months of each entity, one row per window."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from paneltide.operators.ordered import POS, with_frames, with_table_frames
from paneltide.spec import PanelSpec

# Fixed value: months in a sequence.
SEQUENCE_LENGTH = 12


def _items(spec: PanelSpec, cols: Sequence[str]) -> Column:
    # A struct, because collect_list skips bare nulls.
    return F.struct(F.col(spec.time), *[F.col(c).cast("double").alias(c) for c in cols])


def sequence_window(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None = None,
                    length: int = SEQUENCE_LENGTH, drop_last: bool = False) -> DataFrame:
    """Every run of ``length`` rows of an entity: (entity, start, end, window).

    ``drop_last`` leaves out the last window of each entity.
    """
    cols = list(cols or spec.values(df))

    def build(w: WindowSpec) -> dict[str, Column]:
        new = {"window": F.collect_list(_items(spec, cols)).over(w.rowsBetween(1 - length, 0))}
        if drop_last:
            new["__more"] = F.lead(F.lit(True)).over(w)
        return new

    framed = with_frames(df.select(*spec.cell, *cols), spec, length - 1, int(drop_last), build)
    kept = framed.where(F.size("window") == length)
    if drop_last:
        kept = kept.where(F.col("__more").isNotNull())
    return kept.select(*spec.entity, F.col("window")[0][spec.time].alias("start"),
                       F.col(spec.time).alias("end"), "window")


def sequences_in_splits(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None = None,
                        length: int = SEQUENCE_LENGTH, split: str = "split",
                        drop_last: bool = False) -> DataFrame:
    """Windows inside each split: (entity, split, start, end, window).

    Each split is taken as a panel of its own, so no window holds months of two splits.
    """
    cols = list(cols or [c for c in spec.values(df) if c != split])
    within = replace(spec, entity=(*spec.entity, split))
    return sequence_window(df, within, cols, length, drop_last)


def sequences_autoencode(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None = None,
                         length: int = SEQUENCE_LENGTH, drop_last: bool = True) -> DataFrame:
    """Windows whose target is the window itself; by default one fewer than fits."""
    return sequence_window(df, spec, cols, length, drop_last)


def sequences_io(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None = None,
                 length: int = SEQUENCE_LENGTH) -> DataFrame:
    """Input window and the same window one row later: (entity, start, x, y)."""
    cols = list(cols or spec.values(df))

    def build(w: WindowSpec) -> dict[str, Column]:
        item = _items(spec, cols)
        return {"x": F.collect_list(item).over(w.rowsBetween(0, length - 1)),
                "y": F.collect_list(item).over(w.rowsBetween(1, length))}

    framed = with_frames(df.select(*spec.cell, *cols), spec, 0, length, build)
    return (framed.where((F.size("x") == length) & (F.size("y") == length))
                  .select(*spec.entity, F.col(spec.time).alias("start"), "x", "y"))


def sequences_across_entities(df: DataFrame, spec: PanelSpec,
                              cols: Sequence[str] | None = None,
                              length: int = SEQUENCE_LENGTH) -> DataFrame:
    """Windows over the whole table in (entity, time) order: (window_id, x, y).

    Windows cross from one entity to the next, as slices of one long table do.
    """
    cols = list(cols or spec.values(df))

    def build(w: WindowSpec) -> dict[str, Column]:
        item = F.struct(*[F.col(c) for c in spec.entity], _items(spec, cols).alias("row"))
        return {"x": F.collect_list(item).over(w.rowsBetween(0, length - 1)),
                "y": F.collect_list(item).over(w.rowsBetween(1, length))}

    framed = with_table_frames(df.select(*spec.cell, *cols), list(spec.cell), 0, length, build)
    return (framed.where((F.size("x") == length) & (F.size("y") == length))
                  .select(F.col(POS).alias("window_id"), "x", "y"))


def explode_window(windows: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """One row per (window, position)."""
    return (windows.select(*keep, F.posexplode(column).alias("position", "item"))
                   .select(*keep, "position", "item.*"))


def flatten_window(windows: DataFrame, cols: Sequence[str], column: str = "window",
                   name: str = "features") -> DataFrame:
    """Add the window as one array<double>: months in order, indicators within a month."""
    flat = F.flatten(F.transform(column, lambda m: F.array(*[m[c] for c in cols])))
    return windows.withColumn(name, flat)
