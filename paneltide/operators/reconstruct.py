"""Linear reconstruction of sequences and its error as an anomaly score.

A linear autoencoder with squared error spans the subspace of the principal components
(Baldi and Hornik, Neural Networks 2, 1989), so the model is fitted as a PCA.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paneltide.operators.quantiles import percentile_cut


@dataclass(frozen=True)
class Reconstruction:
    """Mean and components of flattened windows (months x indicators values each)."""

    indicators: tuple[str, ...]
    length: int
    mean: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        """(component, month, indicator, weight, mean)."""
        p = len(self.indicators)
        rows = [(k, i // p, self.indicators[i % p], float(w), float(self.mean[i]))
                for k in range(self.components.shape[1])
                for i, w in enumerate(self.components[:, k])]
        return spark.createDataFrame(
            rows, "component int, month int, indicator string, weight double, mean double")


def reconstruction_fit(windows: DataFrame, indicators: Sequence[str], length: int,
                       k: int, features: str = "features") -> Reconstruction:
    """Fit on windows flattened to array<double>. The covariance has the squared length
    of a window, whatever the number of windows."""
    vectors = windows.select(array_to_vector(features).alias("v"))
    mean = vectors.select(Summarizer.mean(F.col("v"))).first()[0].toArray()
    model = PCA(k=k, inputCol="v", outputCol="pc").fit(vectors)
    return Reconstruction(tuple(indicators), length, mean, model.pc.toArray(),
                          model.explainedVariance.toArray())


def reconstruction_score(windows: DataFrame, model: Reconstruction,
                         features: str = "features", name: str = "error") -> DataFrame:
    """Add the mean squared error of each window and the indicator with the largest share.

    ``<name>_share`` maps each indicator to its part of the window's squared error.
    """
    shared = windows.sparkSession.sparkContext.broadcast(
        (model.mean, model.components, model.length, len(model.indicators)))

    @F.arrow_udf("array<double>")
    def squared(rows: pa.Array) -> pa.Array:
        mean, components, length, width = shared.value
        x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), length * width) - mean
        rest = x - (x @ components) @ components.T
        per = (rest * rest).reshape(len(x), length, width).sum(axis=1)
        offsets = np.arange(len(x) + 1, dtype=np.int32) * width
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(per.ravel()))

    return add_errors(windows, squared(F.col(features)), model.indicators, model.length, name)


def add_errors(windows: DataFrame, squared: Column, indicators: Sequence[str], length: int,
               name: str = "error") -> DataFrame:
    """Add error, worst indicator and shares, given each indicator's squared error of a window."""
    names = F.array(*[F.lit(c) for c in indicators])
    total = F.aggregate("__sq", F.lit(0.0), lambda a, b: a + b)
    parts: Column = F.transform("__sq", lambda s: F.coalesce(F.try_divide(s, total), F.lit(0.0)))
    return (windows.withColumn("__sq", squared)
                   .withColumns({
                       name: total / (length * len(indicators)),
                       f"{name}_indicator": F.element_at(
                           names, F.array_position("__sq", F.array_max("__sq")).cast("int")),
                       f"{name}_share": F.map_from_arrays(names, parts)})
                   .drop("__sq"))


def reconstruction_evaluate(scored: DataFrame, error: str = "error", split: str = "split",
                            fit_split: str = "val", percentile: float = 95.0,
                            exact: bool = True) -> DataFrame:
    """Mean error and share of flagged windows per split; the threshold is a percentile
    of one split's errors."""
    cut = percentile_cut(scored.where(F.col(split) == fit_split), error, percentile / 100.0, exact)
    flagged = scored.select(F.col(split), F.col(error), cut.scalar().alias("threshold"))
    return flagged.groupBy(split, "threshold").agg(
        F.count(F.lit(1)).alias("n_windows"), F.avg(error).alias("mean_error"),
        F.count_if(F.col(error) > F.col("threshold")).alias("n_flagged"))
