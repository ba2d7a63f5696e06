"""Densify, fills, features and dates on hand-made panels."""

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from frames import SPEC, month, panel, row, table
from paneltide.functions import columns as C
from paneltide.functions import dates as D
from paneltide.operators import densify as G
from paneltide.operators import features as X
from paneltide.operators import impute as I
from paneltide.operators import sequences as S


@pytest.fixture(scope="module")
def gaps(spark):
    """Two entities, six months; month 2 is missing everywhere, month 4 for entity 2."""
    rows = [row(1, n, float(n)) for n in (0, 1, 3, 4, 5)]
    rows += [row(2, n, 10.0 + n) for n in (0, 1, 3, 5)]
    return panel(spark, rows)


def test_missing_months(gaps):
    assert table(G.missing_months_global(gaps), "date") == [(month(2),)]
    assert table(G.missing_months_per_entity(gaps, SPEC), "subdistrict_code", "date") == [
        (1, month(2)), (2, month(2)), (2, month(4))]


def test_densify_modes(gaps):
    full = G.densify_full(gaps, SPEC, "Total")
    assert full.count() == 12
    assert full.select(*SPEC.cell).distinct().count() == 12
    assert full.where("sector is null").count() == 0
    missing = G.densify_missing(gaps, SPEC)
    assert missing.count() == 11
    assert missing.where("sector is null and a is null").count() == 2


def test_existing_cell_is_not_doubled(gaps):
    listed = [month(1), month(2)]
    absent = G.densify_listed(gaps, SPEC, listed, "Total")
    assert absent.count() == 11
    assert absent.where(F.col("date") == F.lit(month(1))).where("a is null").count() == 0
    doubled = G.densify_listed(gaps, SPEC, listed, "Total", mode="union_distinct")
    assert doubled.where((F.col("date") == F.lit(month(1))) & (F.col("subdistrict_code") == 1)).count() == 2
    with pytest.raises(ValueError):
        G.densify_listed(gaps, SPEC, listed, mode="other")


def test_no_missing_month_adds_nothing(spark):
    df = panel(spark, [row(1, n, 1.0) for n in range(3)])
    assert G.densify_missing(df, SPEC).count() == 3
    assert G.densify_full(df, SPEC).count() == 3


def test_densify_uses_no_join(gaps):
    for df in (G.densify_full(gaps, SPEC), G.cross_entities_dates(
            G.distinct_entities(gaps, SPEC), G.date_axis(gaps))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Cartesian" not in plan


@pytest.fixture(scope="module")
def nulls(spark):
    values = {1: [None, 2.0, None, None, 8.0, None], 2: [None], 3: [None, None, 5.0]}
    return panel(spark, [row(e, n, v) for e, vs in values.items() for n, v in enumerate(vs)])


def series(df, entity, column="a"):
    got = table(df.where(F.col("subdistrict_code") == entity), "date", column)
    return [v for _, v in got]


def test_fills_stay_inside_an_entity(nulls):
    assert series(I.forward_fill(nulls, SPEC, ["a"]), 1) == [None, 2, 2, 2, 8, 8]
    assert series(I.backward_fill(nulls, SPEC, ["a"]), 1) == [2, 2, 8, 8, 8, None]
    both = I.fill_both(nulls, SPEC, ["a"])
    assert series(both, 1) == [2, 2, 2, 2, 8, 8]
    assert series(both, 2) == [None]
    assert series(both, 3) == [5, 5, 5]


def test_fill_crosses_entities_on_request(nulls):
    across = I.fill_across_entities(nulls, SPEC, ["a"])
    assert series(across, 1) == [2, 2, 2, 2, 8, 8]
    assert series(across, 2) == [8]
    assert series(across, 3) == [8, 8, 5]


def test_rolling_impute_keeps_values(nulls):
    assert series(I.rolling_mean_impute(nulls, SPEC, ["a"]), 1) == [None, 2, 2, 2, 8, 8]


def test_smooth_needs_a_full_frame(spark):
    df = panel(spark, [row(1, n, float(n)) for n in range(4)] + [row(2, 0, 1.0), row(2, 1, 2.0)])
    smooth = I.rolling_mean_smooth(df, SPEC, ["a"])
    assert series(smooth, 1) == [None, None, 1, 2]
    assert series(smooth, 2) == [None, None]


def test_chain_leaves_no_null(nulls):
    done = I.impute_chain(nulls, SPEC, ["a"])
    assert done.where("a is null").count() == 0
    # Entity 1 smooths to 2, 2, 4, 6 and entity 3 to 5; the rest takes their mean.
    assert series(done, 2) == [pytest.approx((2 + 2 + 4 + 6 + 5) / 5)]


def test_feature_bundle(spark):
    df = panel(spark, [row(1, n, float(n * n), n) for n in range(5)] + [row(2, 0, 7.0, 3)])
    got = X.feature_bundle(df, SPEC, ["a", "b"])
    assert series(got, 1, "a_lag1") == [None, 0, 1, 4, 9]
    by_month = {r.date: r for r in got.where("subdistrict_code = 1").collect()}
    last = by_month[month(4)]
    assert (last.a_lag1, last.a_lag3, last.b_lag3) == (9, 1, 1)
    assert last.a_roll_avg3 == pytest.approx((1 + 4 + 9 + 16) / 4)
    assert last.a_roll_std3 == pytest.approx(statistics.stdev([1, 4, 9, 16]))
    assert by_month[month(0)].a_roll_std3 is None
    assert last.a_district_avg == pytest.approx((0 + 1 + 4 + 9 + 16 + 7) / 6)


def test_rounds_add_features_of_features(spark):
    df = panel(spark, [row(1, n, float(n)) for n in range(6)])
    one = X.feature_bundle(df, SPEC, ["a"])
    two = X.feature_bundle(df, SPEC, ["a"], rounds=2)
    assert len(one.columns) == len(df.columns) + 5
    assert len(two.columns) == len(df.columns) + 5 + 25
    assert len(set(two.columns)) == len(two.columns)
    got = {r.date: r.a_lag1_lag3 for r in two.collect()}
    assert got[month(5)] == 1.0


def test_group_mean_is_not_a_window(spark):
    df = panel(spark, [row(e, n, float(e), district=e % 2) for e in range(4) for n in range(2)])
    got = X.group_mean_feature(df, SPEC, ["a"])
    assert {(r.district_code, r.a_district_avg) for r in got.collect()} == {(0, 1.0), (1, 2.0)}
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_group_mean_with_many_groups(spark, monkeypatch):
    from paneltide.operators import groups
    monkeypatch.setattr(groups, "BROADCAST_BYTES", 0)
    df = panel(spark, [row(e, n, float(e), district=None if e == 3 else e % 2)
                       for e in range(4) for n in range(2)])
    got = X.group_mean_feature(df, SPEC, ["a"])
    assert {(r.district_code, r.a_district_avg) for r in got.collect()} == {
        (0, 1.0), (1, 1.0), (None, 3.0)}


def test_one_shuffle_for_all_entity_features(spark):
    df = panel(spark, [row(1, n, 1.0) for n in range(3)])
    got = X.lag_features(X.rolling_mean_features(X.rolling_std_features(df, SPEC), SPEC), SPEC, ["a"])
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("rows, plain, dropped, io", [(1, 0, 0, 0), (11, 0, 0, 0), (12, 1, 0, 0),
                                                      (13, 2, 1, 1), (15, 4, 3, 3)])
def test_sequence_counts(spark, rows, plain, dropped, io):
    df = panel(spark, [row(1, n, None if n == 2 else float(n)) for n in range(rows)] + [row(2, 0, 1.0)])
    assert S.sequence_window(df, SPEC, ["a"]).count() == plain
    assert S.sequences_autoencode(df, SPEC, ["a"]).count() == dropped
    assert S.sequences_io(df, SPEC, ["a"]).count() == io


def test_sequences_keep_nulls(spark):
    df = panel(spark, [row(1, n, None if n == 2 else float(n)) for n in range(12)])
    window = S.sequence_window(df, SPEC, ["a"]).first().window
    assert [m.a for m in window] == [0, 1, None, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    flat = S.flatten_window(S.sequence_window(df, SPEC, ["a", "b"]), ["a", "b"]).first().features
    assert len(flat) == 24 and flat[:4] == [0.0, 1.0, 1.0, 1.0]


def test_parse_date_formats(spark):
    df = spark.createDataFrame([("01-04-2017",), ("2017-05-01",), ("n/a",), (None,)], "t string")
    assert [r.d for r in df.select(D.parse_date("t").alias("d")).collect()] == [
        dt.date(2017, 4, 1), dt.date(2017, 5, 1), None, None]


def test_parse_timestamp_formats(spark):
    df = spark.createDataFrame([("2017-04-01T00:00:00.000000",), ("2017-04-01T12:30:00.000000000",),
                                ("2017-04-01",), ("x",)], "t string")
    got = [r.d for r in df.select(D.parse_timestamp("t").alias("d")).collect()]
    assert got == [dt.datetime(2017, 4, 1), dt.datetime(2017, 4, 1, 12, 30), dt.datetime(2017, 4, 1), None]


def test_periods_and_splits(spark):
    df = panel(spark, [row(1, n, 1.0) for n in range(60)])
    flagged = D.flag_period(df)
    assert flagged.where("is_covid_period = 1").count() == 9
    before, after = D.split_periods(df)
    assert (before.count(), after.count()) == (36, 15)
    parts = D.split_by_date(df, dt.date(2019, 12, 31), dt.date(2020, 12, 31))
    assert {(r["split"], r["count"]) for r in parts.groupBy("split").count().collect()} == {
        ("train", 36), ("val", 12), ("test", 12)}
    label = D.date_parts(df).select(D.year_month_label().alias("l")).collect()
    assert ("2017-4",) in [tuple(r) for r in label]


def test_series_extract_choices(spark):
    df = panel(spark, [row(e, n, float(e)) for e in range(40) for n in range(3)])
    assert X.series_extract(df, SPEC, ["a", "b"], codes=[1, 2]).count() == 12
    part = X.series_extract(df, SPEC, ["a"], share=0.5)
    sizes = part.groupBy("subdistrict_code").count().collect()
    assert 0 < len(sizes) < 40 and all(r["count"] == 3 for r in sizes)


def test_column_helpers(spark):
    df = panel(spark, [row(1, 0, None), row(1, 1, 2.0)])
    assert SPEC.values(df) == ["a", "b"]
    assert C.existing_names(df, ["a", "zz"]) == ["a"]
    assert C.drop_cols(df, ["a", "zz"]).columns == [c for c in df.columns if c != "a"]
    assert C.drop_null_rows(df).count() == 1
    assert C.pad_nulls(df.select("date"), df).dtypes == df.dtypes
    table_ = spark.createDataFrame([("b",)], "feature string")
    assert C.select_from_table(df, table_, keep=["date"]).columns == ["date", "b"]


def test_rolling_values_of_many_columns_are_reduced_within_a_row(spark):
    values = [0.1, 0.1, 0.1, 0.1, None, None, None, None, 5.0, None, -2.5, float("nan"), 1.0,
              float("inf"), 2.0, 3.0, 4.0, 7.5]
    rows = [row(e, n, v, None if n % 5 == e else n * e) for e in (1, 2) for n, v in enumerate(values)]
    more = [f"a{i}" for i in range(1, 22)]
    df = panel(spark, rows).select("*", F.col("b").cast("decimal(9,2)").alias("d"),
                                   *[(F.col("a") * i).alias(c) for i, c in enumerate(more, 1)])
    wide = X.feature_bundle(df, SPEC, ["a", "b", "d", *more])
    narrow = X.feature_bundle(df, SPEC, ["a", "b", "d", "a7"])
    names = [n for n in narrow.columns if n not in df.columns]
    assert wide.select(names).schema == narrow.select(names).schema
    assert len(wide.columns) == len(df.columns) + 5 * 24
    got, expected = ([[str(round(v, 9)) if isinstance(v, float) else v for v in r]
                      for r in x.select(*SPEC.cell, *names).orderBy(*SPEC.cell).collect()]
                     for x in (wide, narrow))
    assert got == expected
    assert (wide.where("a_roll_std3 = 0").count() == narrow.where("a_roll_std3 = 0").count() > 0)
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (wide, narrow)]
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    # Only the decimal is aggregated frame by frame.
    assert [plan.count("stddev_samp(") for plan in plans] == [1, 4]
