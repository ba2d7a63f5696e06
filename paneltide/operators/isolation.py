"""Isolation forest: trees grown on small hashed samples, scored in Arrow batches.

Liu, Ting and Zhou, Isolation Forest, ICDM 2008.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from paneltide.operators.quantiles import percentile_cut
from paneltide.session import checkpoint_stage

# Trees, rows per tree, seed, offset of the score and percentile of the label.
TREES = 100
SAMPLE_ROWS = 256
SEED = 42
SCORE_OFFSET = 0.5
PSEUDO_PERCENTILE = 20
EULER_GAMMA = 0.5772156649015329

MODEL_SCHEMA = "tree int, node int, feature int, threshold double, depth double, n_rows int"


def mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER_GAMMA) - 2.0 * (n - 1) / n


def _unit(*cols: Column | str) -> Column:
    """A hash of the columns as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def _ticket(key: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) per row. Without a unique key it comes from a generator, so that
    copies of a row do not share one."""
    return _unit(F.lit(seed), *key) if key else F.rand(seed)


def tree_samples(df: DataFrame, key: Sequence[str], cols: Sequence[str], trees: int = TREES,
                 rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """(tree, draw, x): ``rows`` rows per tree without replacement, chosen by hashes.

    Each tree takes the rows with the lowest hashes of (tree, row), so every tree has a sample of
    its own, drawn in the same way from a table of any size. Rows whose hash is over twice the
    share that is needed on average are dropped where they are read; should a tree get too few
    that way, the share is doubled. ``key`` names columns that identify a row; the choice then
    depends on keys and seed, not on how the table is partitioned.
    """
    ticket = _ticket(key, seed).alias("ticket")
    x = F.array(*[F.col(c).cast("double") for c in cols]).alias("x")
    tickets = df.select(ticket, x)
    total = df.count()
    share, enough = 2.0 * rows / max(total, 1), min(rows, total)
    while True:
        bound = int(share * 2.0 ** 63) if share < 1.0 else 2 ** 63 - 1
        own = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
            t.alias("tree"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), t, "ticket"), 1).alias("draw")))
        drawn = tickets.select("ticket", "x", F.explode(F.filter(own, lambda d: d["draw"] <= bound)).alias("d"))
        rank = F.row_number().over(Window.partitionBy("d.tree").orderBy("d.draw", "x"))
        chosen = checkpoint_stage(drawn.withColumn("__rank", rank).where(F.col("__rank") <= rows)
                                  .select("d.tree", "d.draw", "x"))
        fewest = chosen.groupBy("tree").count().agg(F.min("count"), F.count("*")).first()
        if share >= 1.0 or (fewest[1] == trees and fewest[0] >= enough):
            return chosen
        share *= 2


def _grow(rows: int, seed: int):
    """Grouped-map function that grows one tree from its sample."""
    rest = [mean_path(n) for n in range(rows + 1)]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("draw", kind="stable")
        x = np.stack(pdf["x"].to_numpy())
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        limit = math.ceil(math.log2(max(min(rows, len(x)), 2)))
        out, todo = [], [(0, 0, x)]
        while todo:
            node, depth, part = todo.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            split = np.flatnonzero(high > low)
            if depth == limit or len(part) < 2 or not len(split):
                out.append((tree, node, -1, math.inf, depth + rest[len(part)], len(part)))
                continue
            f = int(rng.choice(split))
            cut = rng.uniform(low[f], high[f])
            right = part[:, f] > cut
            out.append((tree, node, f, float(cut), float(depth), len(part)))
            todo += [(2 * node + 2, depth + 1, part[right]),
                     (2 * node + 1, depth + 1, part[~right])]
        return pd.DataFrame(out, columns=["tree", "node", "feature", "threshold", "depth", "n_rows"])

    return grow


def isolation_forest_fit(df: DataFrame, key: Sequence[str], cols: Sequence[str],
                         trees: int = TREES, rows: int = SAMPLE_ROWS,
                         seed: int = SEED) -> DataFrame:
    """The forest as a table: one row per node, children of node i at 2i+1 and 2i+2.

    A leaf has feature -1 and the path length it stands for in ``depth``.
    """
    samples = tree_samples(df, key, cols, trees, rows, seed)
    return samples.groupBy("tree").applyInPandas(_grow(rows, seed), MODEL_SCHEMA)


@dataclass(frozen=True)
class Forest:
    """The node table as arrays; at most trees x 2 x rows nodes, so it is broadcast."""

    features: tuple[str, ...]
    feature: np.ndarray
    threshold: np.ndarray
    path: np.ndarray
    norm: float

    @property
    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.feature, self.threshold, self.path

    @staticmethod
    def from_table(model: DataFrame, cols: Sequence[str]) -> Forest:
        nodes = model.toPandas()
        trees = int(nodes["tree"].max()) + 1
        levels = int(np.log2(nodes["node"].max() + 1))
        slots = 2 ** (levels + 1) - 1
        feature = np.zeros((trees, slots), dtype=np.int32)
        threshold = np.full((trees, slots), np.inf)
        path = np.zeros((trees, slots))
        for t, i, f, cut, depth in nodes[
                ["tree", "node", "feature", "threshold", "depth"]].itertuples(index=False):
            if f >= 0:
                feature[t, i], threshold[t, i] = f, cut
            while f < 0 and i < slots:
                # A leaf sends every row to its left child, down to the last level.
                path[t, i] = depth
                i = 2 * i + 1
        sampled = nodes.loc[nodes["node"] == 0, "n_rows"].mean()
        return Forest(tuple(cols), feature, threshold, path[:, slots // 2:], mean_path(sampled))


def _paths(nodes: tuple, x: np.ndarray, trees: Sequence[int]) -> np.ndarray:
    """(tree, row) path lengths of the rows of x in some of the trees."""
    feature, threshold, path = nodes
    levels = int(np.log2(feature.shape[1] + 1)) - 1
    row, flat = np.arange(len(x)) * x.shape[1], np.ascontiguousarray(x).ravel()
    out = np.empty((len(trees), len(x)))
    for i, t in enumerate(trees):
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(levels):
            value = flat.take(row + feature[t].take(node))
            node = 2 * node + 1 + (value > threshold[t].take(node))
        out[i] = path[t].take(node - (2 ** levels - 1))
    return out


def _scorer(forest: Forest):
    """Function (node arrays, rows x features) -> scores (lower = more anomalous)."""
    trees, norm, offset = len(forest.feature), forest.norm or 1.0, SCORE_OFFSET

    def score(nodes: tuple, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in range(trees):
            total += _paths(nodes, x, [t])[0]
        return offset - 2.0 ** (-(total / trees) / norm)

    return score


def trees_by_feature(forest: Forest) -> list[list[int]]:
    """For each feature the trees that split on it; a permutation changes no other tree."""
    inner = np.isfinite(forest.threshold)
    return [np.flatnonzero((inner & (forest.feature == j)).any(axis=1)).tolist()
            for j in range(len(forest.features))]


def isolation_forest_score(df: DataFrame, forest: Forest, name: str = "score") -> DataFrame:
    """Add the decision score: below 0 is more anomalous than average."""
    nodes = df.sparkSession.sparkContext.broadcast(forest.nodes)
    score, width = _scorer(forest), len(forest.features)

    @F.arrow_udf("double")
    def decision(rows: pa.Array) -> pa.Array:
        x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)
        return pa.array(score(nodes.value, x))

    packed = F.array(*[F.col(c).cast("double") for c in forest.features])
    return df.withColumn(name, decision(packed))


def pseudo_label(df: DataFrame, score: str = "score", percentile: float = PSEUDO_PERCENTILE,
                 name: str = "pseudo_label", exact: bool = True) -> DataFrame:
    """1 where the score is under its percentile, else 0."""
    cut = percentile_cut(df, score, percentile / 100.0, exact).scalar()
    return df.withColumn(name, (F.col(score) < cut).cast("int"))


def permutation_importance(df: DataFrame, forest: Forest, key: Sequence[str],
                           seed: int = SEED, bucket_rows: int = 10_000) -> DataFrame:
    """(feature, mean_abs_change, mean_change) of the score when one feature is permuted.

    Rows are dealt into random buckets by a hash of the key. Within a bucket each row
    takes the feature values of the next row in hash order, and the last row those of
    the first, which permutes every feature with one shuffle. All features are then
    rescored one by one in the same batch, each through the trees that split on it; the path
    lengths of the other trees are kept.
    """
    cols = list(forest.features)
    total = df.agg(F.count(F.lit(1))).scalar()
    buckets = F.greatest(F.ceil(total / bucket_rows), F.lit(1))
    x = F.array(*[F.col(c).cast("double") for c in cols])
    dealt = (df.select(x.alias("x"), _ticket(key, seed).alias("h"))
               .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), buckets)))
    ring = Window.partitionBy("bucket").orderBy("h", "x")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    paired = dealt.select(
        "x", F.coalesce(F.lead("x").over(ring), F.first("x").over(whole)).alias("other"))
    nodes = df.sparkSession.sparkContext.broadcast(forest.nodes)
    width, trees, norm = len(cols), len(forest.feature), forest.norm or 1.0
    using = trees_by_feature(forest)

    @F.arrow_udf("array<double>")
    def changes(rows: pa.Array, others: pa.Array) -> pa.Array:
        a = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)
        b = others.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)
        base = _paths(nodes.value, a, range(trees))
        total = base.sum(axis=0)
        before = 2.0 ** (-(total / trees) / norm)
        out = np.zeros((len(a), width))
        for j, own in enumerate(using):
            if own:
                changed = a.copy()
                changed[:, j] = b[:, j]
                moved = total + (_paths(nodes.value, changed, own) - base[own]).sum(axis=0)
                out[:, j] = before - 2.0 ** (-(moved / trees) / norm)
        offsets = np.arange(len(a) + 1, dtype=np.int32) * width
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

    delta = paired.select(changes("x", "other").alias("d"))
    row = delta.agg(*[F.struct(F.avg(F.abs(F.col("d")[j])).alias("a"),
                               F.avg(F.col("d")[j]).alias("m")).alias(f"f{j}")
                      for j in range(width)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"f{j}")["a"].alias("mean_abs_change"),
                 F.col(f"f{j}")["m"].alias("mean_change"))
        for j, c in enumerate(cols)])))
