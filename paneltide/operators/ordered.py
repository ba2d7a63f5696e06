"""Ordered windows that do not depend on how rows spread over entities.

A panel with unique monthly cells has small entities, and a window keyed by entity is
one shuffle. When an entity is too large for one task, or when the order runs over the
whole table, rows are sorted into ranges of the full key instead. Each row gets its
position in that order; positions are cut into equal blocks, and a block also receives
the few rows its frames need from its neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F
from pyspark.sql import types as T

from paneltide.session import checkpoint_stage
from paneltide.spec import PanelSpec

BLOCK_ROWS = 100_000
ROW, PART, POS, BLOCK, OWN = "__row", "__part", "__pos", "__block", "__own"
SALT = "__salt"
BEFORE_ALL = Window.unboundedPreceding
AFTER_ALL = Window.unboundedFollowing


def full_order(df: DataFrame, spec: PanelSpec) -> list[str]:
    """Entity, time, then every other sortable column, so that repeated cells are ordered.

    Where cells are declared unique, entity and time are the whole order. Maps and variants
    can't be sorted and are skipped.
    """
    if spec.cells_unique:
        return list(spec.cell)
    rest = [f.name for f in df.schema.fields if f.name not in spec.cell and _sortable(f.dataType)]
    return [*spec.cell, *rest]


def _sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _sortable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_sortable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def entity_window(df: DataFrame, spec: PanelSpec, descending: bool = False) -> WindowSpec:
    """The rows of an entity in the order that the block path uses, or in its reverse."""
    order = full_order(df, spec)[len(spec.entity):]
    return Window.partitionBy(*spec.entity).orderBy(
        *[F.desc(c) if descending else F.asc(c) for c in order])


def sorted_parts(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Range-sort ``df`` and pin the result: adds the part and the row number in it.

    The ranges cover the full key, so one large entity spreads over many parts, and a
    random last key spreads rows that are equal in the whole order. The checkpoint keeps
    the parts fixed for the steps that read them more than once.
    """
    salted = df.withColumn(SALT, F.rand(0))
    numbered = (salted.repartitionByRange(*order, SALT).sortWithinPartitions(*order, SALT)
                      .withColumn(ROW, F.monotonically_increasing_id()).drop(SALT))
    pinned = checkpoint_stage(numbered)
    # monotonically_increasing_id holds the part in the bits above 33.
    return pinned.withColumns({
        PART: F.shiftright(ROW, 33),
        ROW: F.col(ROW).bitwiseAND((1 << 33) - 1),
    })


def with_position(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add the 0-based position of each row in the given order."""
    rows = sorted_parts(df, order)
    sizes = rows.groupBy(PART).agg(F.count(F.lit(1)).alias("n"))
    # One row per shuffle partition, so this window and the broadcast are bounded by
    # spark.sql.shuffle.partitions.
    starts = sizes.select(
        F.col(PART).alias("__p"),
        F.coalesce(F.sum("n").over(Window.orderBy(PART).rowsBetween(BEFORE_ALL, -1)),
                   F.lit(0)).alias("__start"))
    return (rows.join(F.broadcast(starts), F.col(PART) == F.col("__p"))
                .withColumn(POS, F.col("__start") + F.col(ROW))
                .drop("__p", "__start", ROW, PART))


def into_blocks(positioned: DataFrame, before: int, after: int,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per (row, block that needs it); ``__own`` marks the row's own block."""
    if max(before, after) > block_rows:
        raise ValueError("a frame may not be longer than a block")
    home = F.floor(F.col(POS) / block_rows)
    offset = F.col(POS) % block_rows
    needed = F.array_compact(F.array(
        home,
        F.when(offset >= block_rows - before, home + 1),
        F.when(offset < after, home - 1)))
    return (positioned.select("*", home.alias("__home"), F.explode(needed).alias(BLOCK))
                      .withColumn(OWN, F.col("__home") == F.col(BLOCK))
                      .drop("__home"))


def with_frames(df: DataFrame, spec: PanelSpec, before: int, after: int,
                build: Callable[[WindowSpec], Mapping[str, Column]],
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the columns ``build(window)`` whose frames reach ``before`` rows back and
    ``after`` rows ahead within an entity.
    """
    if not spec.has_hot_entity(df):
        return df.withColumns(dict(build(entity_window(df, spec))))
    blocks = into_blocks(with_position(df, full_order(df, spec)), before, after, block_rows)
    window = Window.partitionBy(BLOCK, *spec.entity).orderBy(POS)
    return (blocks.withColumns(dict(build(window))).where(F.col(OWN))
                  .drop(POS, BLOCK, OWN))


def with_table_frames(df: DataFrame, order: Sequence[str], before: int, after: int,
                      build: Callable[[WindowSpec], Mapping[str, Column]],
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Like ``with_frames`` over the whole table in one order; keeps ``__pos``."""
    blocks = into_blocks(with_position(df, order), before, after, block_rows)
    window = Window.partitionBy(BLOCK).orderBy(POS)
    return blocks.withColumns(dict(build(window))).where(F.col(OWN)).drop(BLOCK, OWN)


def carry_fill(df: DataFrame, order: Sequence[str], keys: Sequence[str],
               cols: Sequence[str], forward: bool, backward: bool) -> DataFrame:
    """Fill nulls from the nearest earlier, then the nearest later value, in one order.

    Values stay inside ``keys``; without keys they cross the whole table. Each part
    fills its own rows; what it cannot see comes from a table with the last and first
    value of every part.
    """
    rows = sorted_parts(df, order)
    edge = []
    for c in cols:
        at = F.when(F.col(c).isNotNull(), F.col(ROW))
        edge += [F.max_by(c, at).alias(f"__l_{c}"), F.min_by(c, at).alias(f"__f_{c}")]
    edges = rows.groupBy(PART, *keys).agg(*edge)
    # With keys: the parts one key spans. Without: one row per shuffle partition.
    across = Window.partitionBy(*keys).orderBy(PART)
    across_down = Window.partitionBy(*keys).orderBy(F.desc(PART))
    names = [F.col(k).alias(f"__k_{k}") for k in [PART, *keys]]
    carried = edges.select(*names, *[
        F.last(f"__l_{c}", True).over(across.rowsBetween(BEFORE_ALL, -1)).alias(f"__b_{c}")
        for c in cols
    ], *[
        F.last(f"__f_{c}", True).over(across_down.rowsBetween(BEFORE_ALL, -1)).alias(f"__a_{c}")
        for c in cols
    ])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in [PART, *keys]])
    joined = rows.join(carried, same)
    up = Window.partitionBy(PART, *keys).orderBy(ROW).rowsBetween(BEFORE_ALL, 0)
    down = Window.partitionBy(PART, *keys).orderBy(F.desc(ROW)).rowsBetween(BEFORE_ALL, 0)

    def filled(c: str) -> Column:
        steps = [F.col(c)]
        if forward:
            steps += [F.last(c, True).over(up), F.col(f"__b_{c}")]
        if backward:
            steps += [F.last(c, True).over(down), F.col(f"__a_{c}")]
        return F.coalesce(*steps)

    return joined.select(*[filled(c).alias(c) if c in set(cols) else F.col(c)
                           for c in df.columns])
