"""Column statistics, correlation and the feature filter built on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from paneltide.functions.columns import names_from_table
from paneltide.operators.quantiles import every_column, long_values, quantile_table

# Thresholds of the feature filter.
HIGH_CORRELATION = 0.9
LOW_VARIANCE = 0.01

# Up to here columns are aggregated side by side; beyond, in long form.
MAX_WIDE_COLUMNS = 20

# Columns of one block of the matrix of products, and the bytes of blocks a task may add up.
GRAM_BLOCK = 128
GRAM_BYTES = 256 << 20
# Rows multiplied at once, and shares in which the blocks of all tasks are added up first.
GRAM_ROWS = 4096
GRAM_SHARES = 16


def per_column(df: DataFrame, cols: Sequence[str],
                stats: dict[str, Callable[[str], Column]]) -> DataFrame:
    """Statistics of each numeric column in one aggregate: (feature, stat, ...).

    A few columns are aggregated side by side. Many would make a plan of thousands of
    aggregates, so they go in long form, grouped by column with map-side combine. Both ways
    take the values as doubles and give one row per asked column, an empty table included.
    """
    cols = list(cols)
    if len(cols) > MAX_WIDE_COLUMNS:
        # One row without a value per column keeps the group of a column of an empty table.
        none = every_column(df, cols).withColumn("real", F.lit(False))
        rows = long_values(df, cols).withColumn("real", F.lit(True)).unionByName(none)
        return rows.groupBy("feature").agg(*[f("x").alias(n) for n, f in stats.items()])
    df = df.select(*[F.col(c).cast("double").alias(c) for c in cols],
                   F.lit(True).alias("real"))
    row = df.agg(*[F.struct(*[f(c).alias(n) for n, f in stats.items()]).alias(c) for c in cols])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(c)[n].alias(n) for n in stats])
        for c in cols])))


def column_variance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return per_column(df, cols, {"variance": F.var_samp})


def column_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return per_column(df, cols, {"mean": F.avg})


def column_median(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    return quantile_table(df, cols, [0.5], exact).select(
        "feature", F.col("values")[0].alias("median"))


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)))


def sample_count(df: DataFrame, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Rows in a random sample and the table size that follows from it."""
    return (df.sample(fraction, seed).agg(F.count(F.lit(1)).alias("n_sampled"))
              .withColumn("estimated_rows", F.col("n_sampled") / fraction))


def describe_table(df: DataFrame, cols: Sequence[str] | None = None,
                   exact: bool = True) -> DataFrame:
    """Count, nulls, mean, deviation, bounds and quartiles; one row per column, also of a table
    without rows.

    Numeric columns fill the numeric bounds, other columns the text bounds.
    """
    cols = list(cols or df.columns)
    numeric = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    others = [c for c in cols if c not in set(numeric)]
    parts = []
    if numeric:
        moments = per_column(df, numeric, {
            "count": F.count, "nulls": lambda c: F.count_if(F.col(c).isNull() & F.col("real")),
            "mean": F.avg,
            "std": F.stddev_samp, "min": lambda c: F.min(c).cast("double"),
            "max": lambda c: F.max(c).cast("double")})
        quartiles = quantile_table(df, numeric, [0.25, 0.5, 0.75], exact)
        parts.append(moments.join(quartiles, "feature").select(
            *moments.columns, *[F.lit(None).cast("string").alias(n) for n in ("min_text", "max_text")],
            *[F.col("values")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))]))
    if others:
        # Date and text order agree, so bounds may be taken on text.
        none = F.lit(None).cast("double")
        parts.append(_text_bounds(df, others).select(
            "feature", "count", "nulls", *[none.alias(n) for n in ("mean", "std", "min", "max")],
            "min_text", "max_text", *[none.alias(n) for n in ("q25", "q50", "q75")]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _text_bounds(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, count, nulls, min_text, max_text) of each column as text.

    Bounds of text by group make Spark sort all values, so a few columns are taken side by side.
    """
    stats = {"count": F.count, "nulls": lambda c: F.count_if(F.col(c).isNull() & F.col("real")),
             "min_text": F.min, "max_text": F.max}
    if len(cols) > MAX_WIDE_COLUMNS:
        text = df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("t"), F.lit(True).alias("real"))
            for c in cols])))
        text = text.unionByName(every_column(df, cols).select(
            "feature", F.lit(None).cast("string").alias("t"), F.lit(False).alias("real")))
        return text.groupBy("feature").agg(*[f("t").alias(n) for n, f in stats.items()])
    row = df.select(*[F.col(c).cast("string").alias(f"t{j}") for j, c in enumerate(cols)], F.lit(True).alias("real")).agg(
        *[F.struct(*[f(f"t{j}").alias(n) for n, f in stats.items()]).alias(f"t{j}") for j in range(len(cols))])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(f"t{j}")[n].alias(n) for n in stats])
        for j, c in enumerate(cols)])))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r of every ordered pair over the rows where both are present.

    Rows (col_a, col_b, r, n); r is null where a column is constant on the shared rows. Values are
    centred and scaled by column, so that products keep their digits. Each task multiplies its
    Arrow batches block by block of ``GRAM_BLOCK`` columns; the blocks of all tasks are added up by
    block, one at a time in memory, and turned into pairs where they are added.
    """
    cols = list(cols)
    moments = {r["feature"]: r for r in per_column(df, cols, {
        "mean": F.avg, "scale": F.stddev_pop}).collect()}       # one row per column
    values = df.select(*[
        ((F.col(c).cast("double") - (moments[c]["mean"] or 0.0)) / (moments[c]["scale"] or 1.0)).alias(f"x{i}")
        for i, c in enumerate(cols)])
    blocks = values.mapInArrow(_block_products(len(cols)), _BLOCK_SCHEMA)
    for share in ("share", None):
        keys = ["a", "b", *([share] if share else [])]
        blocks = (blocks.repartition(*keys).sortWithinPartitions(*keys)
                  .mapInArrow(_added_up(None if share else cols),
                              _BLOCK_SCHEMA if share else "col_a string, col_b string, r double, n bigint"))
    return blocks


# Products of the columns of block a with those of block b: rows where both are present, sums and
# squares of either over those rows, and the cross products, one after the other.
_BLOCK_SCHEMA = "a int, b int, share int, products array<double>"
_PRODUCTS = 6


def _block_products(p: int) -> Callable:
    n_blocks = -(-p // GRAM_BLOCK)
    pairs = [(a, b) for a in range(n_blocks) for b in range(a, n_blocks)]
    room = max(1, GRAM_BYTES // (8 * _PRODUCTS * GRAM_BLOCK ** 2))

    def block(x: np.ndarray, k: int) -> np.ndarray:
        return x[:, k * GRAM_BLOCK:(k + 1) * GRAM_BLOCK]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        share = TaskContext.get().partitionId() % GRAM_SHARES
        held: dict[tuple[int, int], np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (a, b), products in held.items():
                yield _block_row(a, b, share, products)
            held.clear()

        for batch in batches:
            for at in range(0, len(batch), GRAM_ROWS):
                columns = [c.slice(at, GRAM_ROWS) for c in batch.columns]
                there = np.stack([np.asarray(c.is_valid()) for c in columns], axis=1).astype(float)
                x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns], axis=1)
                squares = x * x
                for a, b in pairs:
                    m_a, m_b = block(there, a), block(there, b)
                    new = np.stack([m_a.T @ m_b, block(x, a).T @ m_b, m_a.T @ block(x, b),
                                    block(squares, a).T @ m_b, m_a.T @ block(squares, b),
                                    block(x, a).T @ block(x, b)])
                    held[a, b] = held[a, b] + new if (a, b) in held else new
                    if len(held) > room:
                        yield from flush()
        yield from flush()

    return multiply


def _block_row(a: int, b: int, share: int, products: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([share], pa.int32()),
         pa.array([products.ravel()], pa.list_(pa.float64()))], names=["a", "b", "share", "products"])


def _added_up(cols: Sequence[str] | None) -> Callable:
    """Adds up equal blocks of sorted rows: to one row each, or to pairs of ``cols``."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def done() -> pa.RecordBatch:
            return _block_row(*key, total) if cols is None else _pair_rows(cols, key[0], key[1], total)

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "share")), strict=True)
            for i, own in enumerate(keys):
                own = own if cols is None else (*own[:2], 0)
                products = batch.column("products")[i].values.to_numpy(zero_copy_only=False)
                if own == key:
                    total = total + products
                else:
                    if key is not None:
                        yield done()
                    key, total = own, products
        if key is not None:
            yield done()

    return add


def _pair_rows(cols: Sequence[str], a: int, b: int, products: np.ndarray) -> pa.RecordBatch:
    """Both orders of the pairs of two blocks, a pair of a column with itself once."""
    left, right = (np.arange(k * GRAM_BLOCK, min((k + 1) * GRAM_BLOCK, len(cols))) for k in (a, b))
    n, sum_a, sum_b, sq_a, sq_b, cross = products.reshape(_PRODUCTS, len(left), len(right))
    with np.errstate(divide="ignore", invalid="ignore"):
        var_a, var_b = sq_a - sum_a * sum_a / n, sq_b - sum_b * sum_b / n
        # Rounding leaves a tiny positive rest where a column is constant on shared rows.
        constant = ((var_a <= 1e-12 * np.maximum(sq_a, 1e-300)) | (var_b <= 1e-12 * np.maximum(sq_b, 1e-300))
                    | (n < 2))
        r = (cross - sum_a * sum_b / n) / np.sqrt(var_a * var_b)
    i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
    r, none, n = np.where(i == j, 1.0, r.ravel()), (constant.ravel() | np.isnan(r.ravel())), n.ravel()
    upper = i <= j if a == b else np.ones(len(i), dtype=bool)
    i, j, r, none, n = i[upper], j[upper], r[upper], none[upper], n[upper]
    other = i != j
    names = pa.array(cols, pa.string())
    take = lambda x, y: names.take(pa.array(np.concatenate([x, y[other]])))
    return pa.RecordBatch.from_arrays(
        [take(i, j), take(j, i), pa.array(np.concatenate([r, r[other]]), pa.float64(),
                                         mask=np.concatenate([none, none[other]])),
         pa.array(np.concatenate([n, n[other]]).astype(np.int64))], names=["col_a", "col_b", "r", "n"])


def high_corr_pairs(correlations: DataFrame, threshold: float = HIGH_CORRELATION) -> DataFrame:
    """Pairs in both orders whose absolute correlation is over the threshold."""
    return correlations.where((F.col("col_a") != F.col("col_b"))
                              & (F.abs("r") > threshold))


def low_variance_cols(variances: DataFrame, threshold: float = LOW_VARIANCE) -> DataFrame:
    return variances.where(F.col("variance") < threshold)


def redundant_columns(df: DataFrame, cols: Sequence[str],
                      correlation: float = HIGH_CORRELATION, variance: float = LOW_VARIANCE,
                      policy: str = "all") -> DataFrame:
    """Columns the filter drops, as (feature, reason).

    ``all`` drops both members of a correlated pair. ``keep_first`` drops a column that
    correlates with any earlier one and so keeps one of each pair.
    """
    pairs = high_corr_pairs(correlation_matrix(df, cols), correlation)
    if policy == "keep_first":
        order = F.array(*[F.lit(c) for c in cols])
        pairs = pairs.where(F.array_position(order, F.col("col_a"))
                            < F.array_position(order, F.col("col_b")))
    elif policy != "all":
        raise ValueError(f"unknown policy {policy!r}")
    flat = low_variance_cols(column_variance(df, cols), variance)
    return (pairs.select(F.col("col_b").alias("feature"), F.lit("correlated").alias("reason"))
                 .unionByName(flat.select("feature", F.lit("low variance").alias("reason")))
                 .distinct())


def filter_features(df: DataFrame, cols: Sequence[str], correlation: float = HIGH_CORRELATION,
                    variance: float = LOW_VARIANCE, policy: str = "all") -> DataFrame:
    dropped = redundant_columns(df, cols, correlation, variance, policy)
    return df.drop(*names_from_table(dropped, "feature"))
