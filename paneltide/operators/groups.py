"""Statistics of a group joined back to its rows.

A group such as a district may hold any share of the table, so the mean is aggregated
map-side and joined back; no task ever sees a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

# Up to this estimated size the small side of a join is broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024


def count_groups(df: DataFrame, keys: Sequence[str]) -> int:
    """Estimated number of key groups; one small aggregate over the key columns."""
    return df.agg(F.approx_count_distinct(F.struct(*keys))).first()[0]


def join_group_stats(df: DataFrame, keys: Sequence[str], stats: Sequence[tuple[str, Column]],
                     n_groups: int | None = None) -> DataFrame:
    """Append the aggregates ``(name, expression)`` of each key group to its rows.

    The number of groups is measured first, unless the caller knows it. Few groups are broadcast, which leaves
    ``df`` where it is; many groups take a shuffled join, which adaptive execution
    splits where a key is skewed.
    """
    keyed = [F.col(k).alias(f"__g_{k}") for k in keys]
    table = df.groupBy(*keyed).agg(*[e.alias(n) for n, e in stats])
    n_groups = count_groups(df, keys) if n_groups is None else n_groups
    row_bytes = 16 * (len(keys) + len(stats))
    if n_groups * row_bytes <= BROADCAST_BYTES:
        table = F.broadcast(table)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__g_{k}")) for k in keys])
    return (df.join(table, same, "left")
              .select(*df.columns, *[n for n, _ in stats]))
