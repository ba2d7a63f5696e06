"""From a raw panel to anomaly scores, as chained DataFrame steps.

Each step that reads its input more than once gets a staged table, so the work before it
runs once and a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from paneltide.functions.columns import filter_slice
from paneltide.functions.dates import split_by_date
from paneltide.operators.densify import densify_full
from paneltide.operators.importance import TOP_K, forest_importance, top_k_features
from paneltide.operators.impute import impute_chain, median_impute
from paneltide.operators.isolation import (
    Forest, isolation_forest_fit, isolation_forest_score, pseudo_label,
)
from paneltide.operators.reconstruct import (
    reconstruction_evaluate, reconstruction_fit, reconstruction_score,
)
from paneltide.operators.recurrent import recurrent_fit, recurrent_score
from paneltide.operators.scale import minmax_scale, standard_scale
from paneltide.operators.sequences import (
    SEQUENCE_LENGTH, flatten_window, sequence_window, sequences_in_splits,
)
from paneltide.operators.stats import filter_features
from paneltide.sources.io import stage_via_parquet
from paneltide.spec import PanelSpec

# Last day of the training and of the validation period.
TRAIN_END = dt.date(2019, 12, 31)
VAL_END = dt.date(2020, 12, 31)

Stage = Callable[[DataFrame], DataFrame]


def prepare_panel(raw: DataFrame, spec: PanelSpec, slice_value: str = "Total",
                  stage: Stage = stage_via_parquet) -> DataFrame:
    """One slice of the raw panel with every month present and every null filled."""
    panel = filter_slice(raw, spec.slice_col, slice_value)
    return stage(impute_chain(densify_full(panel, spec, slice_value), spec, stage=stage))


def model_panel(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None = None) -> DataFrame:
    """The feature table of the isolation forest: medians for nulls, then standardised."""
    cols = list(cols or spec.values(df))
    return standard_scale(median_impute(df, cols), cols)


def score_cells(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None = None,
                stage: Stage = stage_via_parquet) -> DataFrame:
    """Every (entity, month) cell with its scaled features and isolation score."""
    cols = list(cols or spec.values(df))
    ready = stage(model_panel(df, spec, cols))
    forest = Forest.from_table(isolation_forest_fit(ready, spec.cell, cols), cols)
    return isolation_forest_score(ready, forest)


def select_indicators(panel: DataFrame, spec: PanelSpec, k: int = TOP_K, policy: str = "all",
                      stage: Stage = stage_via_parquet) -> DataFrame:
    """The indicators that explain the pseudo-labels best: (feature, importance)."""
    kept = filter_features(panel, spec.values(panel), policy=policy)
    cols = spec.values(kept)
    labelled = pseudo_label(stage(score_cells(kept, spec, cols, stage)))
    return top_k_features(forest_importance(labelled, cols), k)


def score_sequences(panel: DataFrame, spec: PanelSpec, indicators: Sequence[str],
                    train_end: dt.date = TRAIN_END, val_end: dt.date = VAL_END,
                    length: int = SEQUENCE_LENGTH, k: int = 16, model: str = "linear",
                    within_splits: bool = False, stage: Stage = stage_via_parquet) -> DataFrame:
    """Reconstruction error of every window; scaler and model see training months only.

    ``model`` is linear (a PCA of ``k`` components) or recurrent. A window belongs to the split of
    its last month, or, ``within_splits``, is built from the months of one split alone.
    """
    train = panel.where(F.col(spec.time) <= F.lit(train_end))
    scaled = minmax_scale(panel, indicators, train)
    if within_splits:
        parted = split_by_date(scaled, train_end, val_end, spec.time)
        windows = sequences_in_splits(parted, spec, indicators, length)
    else:
        windows = split_by_date(sequence_window(scaled, spec, indicators, length), train_end, val_end, "end")
    windows = stage(flatten_window(windows, indicators).drop("window"))
    fitting = windows.where("split = 'train'")
    if model == "linear":
        scored = reconstruction_score(windows, reconstruction_fit(fitting, indicators, length, k))
    elif model == "recurrent":
        scored = recurrent_score(windows, recurrent_fit(fitting, indicators, length))
    else:
        raise ValueError(f"unknown model {model!r}")
    return scored.drop("features")


def evaluate_sequences(scored: DataFrame, percentile: float = 95.0,
                       stage: Stage = stage_via_parquet) -> DataFrame:
    return reconstruction_evaluate(stage(scored.select("split", "error")), percentile=percentile)
