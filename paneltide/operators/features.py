"""Lag, rolling and group features, the model matrix and series in long form."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F
from pyspark.sql import types as T

from paneltide.functions.columns import existing_names
from paneltide.operators.groups import count_groups, join_group_stats
from paneltide.operators.ordered import with_frames
from paneltide.spec import PanelSpec

# Lags, the rows before the current one in a rolling frame, and the names
# of the derived columns.
LAGS = (1, 3)
ROLLING_PRECEDING = 3
LAG_NAME = "{column}_lag{lag}"
ROLL_AVG_NAME = "{column}_roll_avg{preceding}"
ROLL_STD_NAME = "{column}_roll_std{preceding}"
GROUP_AVG_NAME = "{column}_district_avg"

# Of more columns than WIDE, rolling frames reaching back up to SIDE_BY_SIDE rows are reduced
# within a row, if the columns are of these types.
WIDE, SIDE_BY_SIDE = 20, 5
PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def _lags(w: WindowSpec, cols: Sequence[str], lags: Sequence[int]) -> dict[str, Column]:
    return {LAG_NAME.format(column=c, lag=k): F.lag(c, k).over(w) for c in cols for k in lags}


def _rolling(w: WindowSpec, cols: Sequence[str], preceding: int, name: str,
             agg: Callable[[str], Column]) -> dict[str, Column]:
    frame = w.rowsBetween(-preceding, 0)
    return {name.format(column=c, preceding=preceding): agg(c).over(frame) for c in cols}


def _mean(values: Sequence[str]) -> str:
    """SQL for the mean of a row's values that are not null, added up in the given order."""
    n, total = _count(values), _total(values)
    return f"CASE WHEN {n} > 0 THEN {total} / {n} END"


def _deviation(values: Sequence[str]) -> str:
    """SQL for the sample standard deviation of a row's values that are not null.

    The squared distances of all pairs add up to n times those from the mean, so equal values
    give exactly 0. A value that is not finite gives NaN, as in the aggregate.
    """
    n, total = _count(values), _total(values)
    pairs = " + ".join(f"coalesce(({a} - {b}) * ({a} - {b}), 0D)" for a, b in combinations(values, 2))
    return f"CASE WHEN {n} > 1 THEN sqrt(({pairs} + ({total} - {total})) / ({n} * ({n} - 1))) END"


def _count(values: Sequence[str]) -> str:
    return "(" + " + ".join(f"int({v} IS NOT NULL)" for v in values) + ")"


def _total(values: Sequence[str]) -> str:
    return "(" + " + ".join(["0D", *(f"coalesce({v}, 0D)" for v in values)]) + ")"


def _framed(df: DataFrame, spec: PanelSpec, cols: Sequence[str], lags: Sequence[int],
            preceding: int, kinds: Sequence[tuple]) -> DataFrame:
    """Add lags and the rolling values of ``kinds``: (name, aggregate, same over a row's values).

    A rolling frame is aggregated anew for every row; with many columns that costs far more than
    the sort. Above ``WIDE`` columns, short frames of plain numbers are therefore laid beside
    their row by lags, which all columns share, and reduced within the row.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    beside = ([c for c in cols if isinstance(types.get(c), PLAIN)]
              if len(cols) > WIDE and 1 <= preceding <= SIDE_BY_SIDE else [])
    if not beside:
        return with_frames(df, spec, max([*lags, preceding]), 0, lambda w: {
            **_lags(w, cols, lags),
            **{n: x for name, agg, _ in kinds for n, x in _rolling(w, cols, preceding, name, agg).items()}})
    others = [c for c in cols if c not in set(beside)]
    # Helpers get names of their own, so that a new column may replace one that others read.
    helpers = {(c, k): f"__lag{k}_{i}" for i, c in enumerate(cols)
               for k in sorted({*lags, *(range(1, preceding + 1) if c in set(beside) else ())})}
    wide = {(name, c): f"__wide{i}_{j}" for i, (name, _, _) in enumerate(kinds) for j, c in enumerate(others)}

    def build(w: WindowSpec) -> dict[str, Column]:
        frame = w.rowsBetween(-preceding, 0)
        return {**{helper: F.lag(c, k).over(w) for (c, k), helper in helpers.items()},
                **{wide[name, c]: agg(c).over(frame) for name, agg, _ in kinds for c in others}}

    def values(c: str) -> list[str]:
        row = [*(helpers[c, k] for k in range(preceding, 0, -1)), "`" + c.replace("`", "``") + "`"]
        return row if types[c] == T.DoubleType() else [f"double({v})" for v in row]

    new = {LAG_NAME.format(column=c, lag=k): F.col(helpers[c, k]) for c in cols for k in lags}
    for name, _, over in kinds:
        new |= {name.format(column=c, preceding=preceding):
                F.col(wide[name, c]) if (name, c) in wide else F.expr(over(values(c))) for c in cols}
    framed = with_frames(df, spec, max([*lags, preceding]), 0, build)
    return framed.withColumns(new).drop(*helpers.values(), *wide.values())


def lag_features(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None = None,
                 lags: Sequence[int] = LAGS) -> DataFrame:
    cols = list(cols or spec.values(df))
    return with_frames(df, spec, max(lags), 0, lambda w: _lags(w, cols, lags))


def rolling_mean_features(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None = None,
                          preceding: int = ROLLING_PRECEDING) -> DataFrame:
    cols = list(cols or spec.values(df))
    return _framed(df, spec, cols, (), preceding, [ROLL_AVG])


def rolling_std_features(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None = None,
                         preceding: int = ROLLING_PRECEDING) -> DataFrame:
    """Sample standard deviation; null on a frame with one value."""
    cols = list(cols or spec.values(df))
    return _framed(df, spec, cols, (), preceding, [ROLL_STD])


ROLL_AVG = (ROLL_AVG_NAME, F.avg, _mean)
ROLL_STD = (ROLL_STD_NAME, F.stddev_samp, _deviation)


def group_mean_feature(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None = None,
                       n_groups: int | None = None) -> DataFrame:
    """Mean of the group (district) on each of its rows."""
    cols = list(cols or spec.values(df))
    return join_group_stats(df, spec.group, [
        (GROUP_AVG_NAME.format(column=c), F.avg(c)) for c in cols], n_groups)


def feature_bundle(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None = None,
                   lags: Sequence[int] = LAGS, preceding: int = ROLLING_PRECEDING,
                   rounds: int = 1,
                   stage: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Lags, rolling mean, rolling deviation and group mean of every indicator.

    All entity windows of a round are built in one projection and share one shuffle.
    With ``rounds`` > 1 the bundle is applied again to the columns the round before
    added; ``stage`` materialises the panel between rounds.
    """
    cols = list(cols or spec.values(df))
    n_groups = count_groups(df, spec.group)
    for number in range(rounds):
        if number and stage is not None:
            df = stage(df)
        before = set(df.columns)
        df = _framed(df, spec, cols, lags, preceding, [ROLL_AVG, ROLL_STD])
        df = group_mean_feature(df, spec, cols, n_groups)
        # The earlier columns keep the features they have; only new columns get some.
        cols = [c for c in df.columns if c not in before]
    return df


def model_matrix(df: DataFrame, features: Iterable[str], identifiers: Iterable[str],
                 context: Iterable[str] = ()) -> DataFrame:
    """Features, identifiers and context columns that exist; rows with nulls dropped."""
    wanted = existing_names(df, dict.fromkeys([*features, *identifiers, *context]))
    return df.select(*wanted).na.drop()


def series_extract(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None = None,
                   codes: Sequence | None = None, share: float | None = None,
                   seed: int = 42) -> DataFrame:
    """(entity, time, feature, value) series of all, of chosen, or of a share of entities.

    The share is drawn by a hash of the entity, so every series stays whole.
    """
    cols = list(cols or spec.values(df))
    if codes is not None:
        df = df.where(F.col(spec.entity[0]).isin(list(codes)))
    if share is not None:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *spec.entity), 11)
        df = df.where(bits / float(1 << 53) < share)
    return (df.select(*spec.cell, *[F.col(c).cast("double") for c in cols])
              .unpivot(list(spec.cell), cols, "feature", "value"))


def monthly_trends(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None = None) -> DataFrame:
    """Mean of every indicator by year and month, as columns ``avg(indicator)``."""
    cols = list(cols or spec.values(df))
    return (df.groupBy(F.year(spec.time).alias("year"), F.month(spec.time).alias("month"))
              .agg(*[F.avg(c).alias(f"avg({c})") for c in cols]))


def trend_series(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None = None) -> DataFrame:
    """Monthly trends with one row per month and indicator."""
    cols = list(cols or spec.values(df))
    trends = monthly_trends(df, spec, cols)
    return trends.select(
        "year", "month",
        F.concat_ws("-", F.col("year").cast("string"), F.col("month").cast("string"))
         .alias("year_month"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"),
                                    F.col(f"`avg({c})`").alias("mean")) for c in cols])))
