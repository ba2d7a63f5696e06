"""Which indicators explain the pseudo-labels, and the choice of the top ones."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from paneltide.functions.columns import select_from_table
from paneltide.operators.forest import SMALL_ROWS, impurity_decreases

# Trees, seed and number of selected features.
TREES = 100
SEED = 42
TOP_K = 20


def forest_importance(df: DataFrame, cols: Sequence[str], label: str = "pseudo_label",
                      trees: int = TREES, seed: int = SEED, key: Sequence[str] = (),
                      small_rows: int = SMALL_ROWS) -> DataFrame:
    """Impurity importance of each feature in a random forest: (feature, importance).

    Trees grow until their leaves are pure. Each tree's decreases are taken as shares of its sum;
    the importance is their mean over the trees, and 0 for all features if nothing can be split.
    Reads ``df`` several times, so pass a staged table. The result depends on neither the input's
    partitions nor the number of cores.
    """
    found = impurity_decreases(df, cols, label, trees, seed, key, small_rows)
    sums = found.sum(axis=1, keepdims=True)
    shares = np.divide(found, sums, out=np.zeros_like(found), where=sums > 0).mean(axis=0)
    if shares.sum() > 0:
        shares = shares / shares.sum()
    rows = [(c, float(v)) for c, v in zip(cols, shares, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def top_k_features(importances: DataFrame, k: int = TOP_K) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(k)


def select_top_features(df: DataFrame, importances: DataFrame, keep: Iterable[str] = (),
                        k: int = TOP_K) -> DataFrame:
    return select_from_table(df, top_k_features(importances, k), "feature", keep)
