"""Operators give one result whatever a size makes them choose."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from frames import MEASURED, SPEC, panel, row, table
from paneltide import spec as spec_module
from paneltide.operators import densify as D
from paneltide.operators import features as X
from paneltide.operators import impute as I
from paneltide.operators import profile as P
from paneltide.operators import quantiles as Q
from paneltide.operators import scale
from paneltide.operators import sequences as S
from paneltide.operators import stats as T
from paneltide.spec import PanelSpec

RUNS = [
    (lambda d: X.lag_features(d, MEASURED, ["a"]), ["id", "a", "a_lag1", "a_lag3"]),
    (lambda d: X.rolling_mean_features(d, MEASURED, ["a"]), ["id", "a", "a_roll_avg3"]),
    (lambda d: I.forward_fill(d, MEASURED, ["a"]), ["id", "b", "a"]),
    (lambda d: I.backward_fill(d, MEASURED, ["a"]), ["id", "b", "a"]),
    (lambda d: I.fill_both(d, MEASURED, ["a"]), ["id", "b", "a"]),
    (lambda d: I.rolling_mean_impute(d, MEASURED, ["a"]), ["id", "b", "a"]),
    (lambda d: S.sequence_window(d, MEASURED, ["a"], 3).select(
        F.to_json(F.struct("*")).alias("all")), ["all"]),
]


@pytest.fixture(scope="module")
def repeated(spark):
    """Every month of one entity occurs up to three times; a map column can't be sorted."""
    rows = [row(1, n, None if (n + k) % 3 == 0 else float(100 * n + 7 * k % 5), k)
            for n in range(40) for k in range(1 + n % 3)]
    df = panel(spark, rows[::-1]).withColumn("tags", F.create_map(F.lit("k"), F.col("b")))
    return df.repartition(4).cache()


@pytest.mark.parametrize("run, cols", RUNS)
def test_repeated_cells_on_both_sides_of_the_limit(repeated, monkeypatch, run, cols):
    below = table(run(repeated), *cols)
    monkeypatch.setattr(spec_module, "MAX_ENTITY_ROWS", 10)
    assert table(run(repeated), *cols) == below


@pytest.mark.parametrize("n", [0, 30])
def test_column_statistics_whatever_the_width(spark, monkeypatch, n):
    df = spark.range(n).select(F.col("id").cast("decimal(10,2)").alias("d"),
                               F.when(F.col("id") % 3 > 0, F.col("id")).alias("i"))
    wide = [T.per_column(df, ["d", "i"], s) for s in ({"mean": F.avg, "n": F.count},)]
    wide += [T.describe_table(df), scale.minmax_scale(df, ["d", "i"]), T.column_variance(df, ["d"])]
    got = [(f.schema.simpleString(), sorted(map(str, f.collect()))) for f in wide]
    monkeypatch.setattr(T, "MAX_WIDE_COLUMNS", 0)
    long = [T.per_column(df, ["d", "i"], s) for s in ({"mean": F.avg, "n": F.count},)]
    long += [T.describe_table(df), scale.minmax_scale(df, ["d", "i"]), T.column_variance(df, ["d"])]
    assert got == [(f.schema.simpleString(), sorted(map(str, f.collect()))) for f in long]


def test_nan_ranks_last_and_brackets_narrow(spark, monkeypatch):
    df = spark.range(3000).select(F.when(F.col("id") == 5, float("nan")).otherwise(
        F.col("id") * 1.5).alias("x"))
    qs = [0.0, 0.25, 0.5, 0.999, 1.0]
    exact = Q.quantile_table(df, ["x"], qs).first()["values"]
    seen = []
    pick = Q._pick
    monkeypatch.setattr(Q, "_pick", lambda v, b: seen.extend(b.values()) or pick(v, b))
    narrowed = Q.quantile_table(df, ["x"], qs, max_rows=10, max_bracket=50).first()["values"]
    assert math.isnan(exact[-1]) and math.isnan(narrowed[-1])
    assert narrowed[:-1] == exact[:-1]
    assert all(b.inside <= 50 or b.low == b.high for b in seen)


def test_grid_is_keyed_by_the_entity(spark):
    rows = [row(1, n, 1.0) for n in (0, 2, 4)]
    renamed = panel(spark, rows).withColumn("subdistrict_name", F.when(
        F.col("date") < dt.date(2017, 2, 1), "old").otherwise("new"))
    cells = D.densify_full(renamed, SPEC)
    assert cells.count() == 5 == cells.select(*SPEC.cell).distinct().count()
    assert {r.subdistrict_name for r in D.missing_months_per_entity(renamed, SPEC).collect()} == {"new"}
    apart = PanelSpec(entity=("subdistrict_code",), attrs=("state_name",))
    assert D.densify_full(renamed, apart).count() == 5
    assert D.densify_listed(renamed, SPEC, [dt.date(2017, 2, 1), dt.date(2017, 3, 1)]).count() == 4


def test_text_bounds_side_by_side_take_no_sort(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("a"), F.lit(None).cast("date").alias("b"))
    plan = T.describe_table(df)._jdf.queryExecution().toString()
    assert "SortAggregate(key=[feature" not in plan
    assert [(r.feature, r["count"], r.nulls, r.min_text, r.max_text) for r in T.describe_table(df).collect()] == [
        ("a", 30, 0, "0", "9"), ("b", 0, 30, None, None)]


@pytest.mark.parametrize("width", [20, 0])
def test_distinct_counts_whatever_the_width(spark, monkeypatch, width):
    monkeypatch.setattr(P, "MAX_WIDE_COLUMNS", width)
    df = spark.createDataFrame([(0.0, "x"), (-0.0, "y"), (float("nan"), None), (float("nan"), "x"), (None, "x")],
                               "a double, b string")
    assert {r.feature: r.distinct for r in P.column_profile(df).collect()} == {"a": 2, "b": 2}
    # Side by side no value is written out with its column's name.
    assert ("Generate inline" in P._distinct_counts(df, df.columns)._jdf.queryExecution().toString()) == (width == 0)
