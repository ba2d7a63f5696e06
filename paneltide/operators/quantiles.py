"""Quantiles with linear interpolation, exact at any size, or approximate.

Columns are taken in long form, one group per column, so the plan does not grow with the
width of the table. Spark's exact ``percentile`` keeps all distinct values of a group in
one task and is used up to a row limit. Beyond it each wanted rank is bracketed by a range of
keys, integers in the order of the numbers. A pass counts the rows of each bracket in equal bins
and narrows it to the bin of its rank, until the values in it fit in one task: at most one pass
per ``BIN_BITS`` bits of a key, whatever the values and their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F

# Rows per column the built-in exact percentile may hold in one task.
MAX_EXACT_ROWS = 1_000_000
# Values of one bracket that may be sorted in one task.
MAX_BRACKET_ROWS = 10_000
ACCURACY = 10_000
# A pass divides a bracket into 2**BIN_BITS bins; counts of one pass.
BIN_BITS = 12
COUNTS_AT_ONCE = 4_000_000

_ALL_BUT_SIGN = np.int64(2 ** 63 - 1)


def long_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, x): every value of the columns as a double, nulls included."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])))


def every_column(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, x) with a null for each column: keeps the group of a column of an empty table."""
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return names.select("feature", F.lit(None).cast("double").alias("x"))


def quantile_table(df: DataFrame, cols: Sequence[str], qs: Sequence[float], exact: bool = True,
                   max_rows: int = MAX_EXACT_ROWS,
                   max_bracket: int = MAX_BRACKET_ROWS) -> DataFrame:
    """(feature, values): per column an array with its quantiles in the order of ``qs``.

    With ``exact`` the input is read more than once; pass a staged table. A column without values
    has a row of null.
    """
    values = long_values(df, cols).unionByName(every_column(df, cols))
    if not exact:
        found = F.percentile_approx("x", [float(q) for q in qs], ACCURACY)
        return values.groupBy("feature").agg(found.alias("values"))
    if df.count() <= max_rows:
        found = F.percentile("x", F.array(*[F.lit(float(q)) for q in qs]))
        return values.groupBy("feature").agg(found.alias("values"))
    rows = _by_rank(df, cols, qs, max_bracket)
    return df.sparkSession.createDataFrame(rows, "feature string, values array<double>")


def percentile_cut(df: DataFrame, column: str, q: float = 0.2, exact: bool = True) -> DataFrame:
    """One row with the ``q`` quantile of a column."""
    return quantile_table(df, [column], [q], exact).select(F.col("values")[0].alias("cut"))


@dataclass
class _Bracket:
    """A range of keys that holds the row of one rank; ``below`` rows lie under it."""

    column: int
    rank: int
    low: int
    high: int
    below: int
    inside: int

    @property
    def range(self) -> tuple[int, int, int]:
        return self.column, self.low, self.high

    @property
    def shift(self) -> int:
        """The bits of a key that its bin leaves out."""
        return max(0, (self.high - self.low).bit_length() - BIN_BITS)


def _keys(column: pa.Array) -> tuple[np.ndarray, int]:
    """The numbers of a column as integers in the same order, and how many values are NaN."""
    x = column.drop_null().to_numpy(zero_copy_only=False)
    numbers = x[~np.isnan(x)]
    bits = (numbers + 0.0).view(np.int64)       # -0.0 becomes 0.0
    return np.where(bits < 0, bits ^ _ALL_BUT_SIGN, bits), len(x) - len(numbers)


def _value(key: int) -> float:
    bits = np.array([key if key >= 0 else key ^ int(_ALL_BUT_SIGN)], dtype=np.int64)
    return float(bits.view(np.float64)[0])


def _bounds(doubles: DataFrame) -> dict[int, Row]:
    """Per column the number of its numbers and NaNs and its least and greatest key."""
    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for j, column in enumerate(batch.columns):
                keys, nan = _keys(column)
                own = found.setdefault(j, [0, 0, None, None])
                own[:2] = own[0] + len(keys), own[1] + nan
                if len(keys):
                    low, high = int(keys.min()), int(keys.max())
                    own[2:] = (low, high) if own[2] is None else (min(low, own[2]), max(high, own[3]))
        rows = [(j, *own) for j, own in found.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int32() if not i else pa.int64()) for i in range(5)],
            names=["col", "n", "nan", "low", "high"])

    found = doubles.mapInArrow(bounds, "col int, n long, nan long, low long, high long").groupBy("col").agg(
        F.sum("n").alias("n"), F.sum("nan").alias("nan"), F.min("low").alias("low"), F.max("high").alias("high"))
    return {r["col"]: r for r in found.collect()}       # one row per column


def _by_rank(df: DataFrame, cols: Sequence[str], qs: Sequence[float],
             max_bracket: int) -> list[tuple[str, list[float | None]]]:
    doubles = df.select(*[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(cols)])
    bounds = _bounds(doubles)
    rows = {j: b["n"] + b["nan"] for j, b in bounds.items()}
    brackets: dict[tuple[int, int], _Bracket] = {}
    for j, b in bounds.items():
        for q in qs if rows[j] else ():
            at = (rows[j] - 1) * q
            for rank in (math.floor(at), math.ceil(at)):
                if rank < b["n"]:
                    brackets[j, rank] = _Bracket(j, rank, b["low"], b["high"], 0, b["n"])
    while wide := [b for b in brackets.values() if b.low < b.high and b.inside > max_bracket]:
        _narrow(doubles, wide)
    value = _pick(doubles, brackets)

    def interpolated(j: int, q: float) -> float | None:
        if not rows.get(j):
            return None
        at = (rows[j] - 1) * q
        # NaN ranks after every number, as in Spark's percentile, whose formula this is.
        low, high = (value.get((j, rank), math.nan) for rank in (math.floor(at), math.ceil(at)))
        if low == high or math.floor(at) == math.ceil(at):
            return low
        return (math.ceil(at) - at) * low + (at - math.floor(at)) * high

    return [(c, [interpolated(j, q) for q in qs]) for j, c in enumerate(cols)]


def _in_range(keys: np.ndarray, low: int, high: int) -> np.ndarray:
    """The distances from ``low`` of the keys in a range, which may exceed a signed integer."""
    inside = keys[(keys >= low) & (keys <= high)]
    return inside.view(np.uint64) - np.array([low], dtype=np.int64).view(np.uint64)


def _narrow(doubles: DataFrame, wide: Sequence[_Bracket]) -> None:
    """Shrink each bracket to one of its bins, which every task counts for its rows."""
    found = [b.range for b in wide]
    ranges = list(dict.fromkeys(found))
    shifts = {b.range: b.shift for b in wide}
    at_once = max(1, COUNTS_AT_ONCE >> BIN_BITS)
    for start in range(0, len(ranges), at_once):
        some = ranges[start:start + at_once]
        used = [doubles.columns[j] for j in sorted({r[0] for r in some})]

        def count(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(some), 1 << BIN_BITS), dtype=np.int64)
            for batch in batches:
                keys = {name: _keys(column)[0] for name, column in zip(batch.schema.names, batch.columns, strict=True)}
                for i, (j, low, high) in enumerate(some):
                    bins = _in_range(keys[f"x{j}"], low, high) >> np.uint64(shifts[j, low, high])
                    total[i] += np.bincount(bins.astype(np.int64), minlength=1 << BIN_BITS)
            at, bin_ = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bin_.astype(np.int32)),
                                              pa.array(total[at, bin_])], names=["id", "bin", "n"])

        added = (doubles.select(*used).mapInArrow(count, "id int, bin int, n long")
                 .groupBy("id", "bin").agg(F.sum("n").alias("n")).toArrow())      # COUNTS_AT_ONCE at most
        table = np.zeros((len(some), 1 << BIN_BITS), dtype=np.int64)
        table[added.column("id").to_numpy(), added.column("bin").to_numpy()] = added.column("n").to_numpy()
        place = {r: i for i, r in enumerate(some)}
        for b, own in zip(wide, found, strict=True):
            if own in place:
                counts, shift = table[place[own]], shifts[own]
                upto = counts.cumsum()
                at = int(np.searchsorted(upto, b.rank - b.below, side="right"))
                b.below, b.inside = b.below + int(upto[at] - counts[at]), int(counts[at])
                b.low += at << shift
                b.high = min(b.high, b.low + (1 << shift) - 1)


def _pick(doubles: DataFrame, brackets: dict[tuple[int, int], _Bracket]) -> dict[tuple[int, int], float]:
    """The value of each rank; brackets of more than one key are sorted, each in one task."""
    found = {key: _value(b.low) for key, b in brackets.items() if b.low == b.high}
    rest = {key: b for key, b in brackets.items() if key not in found}
    if rest:
        ranges = list(dict.fromkeys(b.range for b in rest.values()))

        def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = [_keys(column)[0] for column in batch.columns]
                held = [keys[j][(keys[j] >= low) & (keys[j] <= high)] for j, low, high in ranges]
                ids = np.repeat(np.arange(len(ranges), dtype=np.int32), [len(k) for k in held])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(held))], names=["id", "key"])

        places: dict[int, list[int]] = {}
        for b in rest.values():
            places.setdefault(ranges.index(b.range), []).append(b.rank - b.below + 1)
        wanted = F.create_map(*[x for i, at in places.items() for x in (F.lit(i), F.array(*[F.lit(n) for n in at]))])
        held = (doubles.mapInArrow(inside, "id int, key long").groupBy("id")
                .agg(F.array_sort(F.collect_list("key")).alias("keys")))
        picked = {r["id"]: r["found"] for r in held.select("id", F.transform(
            F.element_at(wanted, F.col("id")), lambda at: F.element_at("keys", at)).alias("found")).collect()}
        for key, b in rest.items():
            i = ranges.index(b.range)
            found[key] = _value(picked[i][places[i].index(b.rank - b.below + 1)])
    return found
