"""Deliveries month by month, merged sketches, faulty CSV lines and empty tables."""

import datetime as dt
import random

import pytest
from frames import SPEC, month, panel, row, table
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.operators.features import lag_features, rolling_mean_features
from paneltide.operators.impute import forward_fill
from paneltide.operators.monthly import fill_forward_month, merged_profile, month_sketches, with_month
from paneltide.operators.profile import column_profile
from paneltide.operators.quantiles import percentile_cut
from paneltide.operators.stats import column_median, describe_table
from paneltide.sources.checked_csv import scan_csv_checked
from paneltide.sources.io import stage_via_parquet


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(4)
    rows = [row(e, n, r.choice([None, None, float(r.randrange(9))]), r.randrange(5))
            for e in range(5) for n in range(7) if n < 2 or r.random() < 0.7]
    return stage_via_parquet(panel(spark, rows))


def deliveries(data):
    return [data.where(F.col("date") == F.lit(month(n))) for n in range(7)]


def test_lags_and_means_month_by_month_equal_the_whole(data):
    for step, names in ((lambda df: lag_features(df, SPEC, ["a", "b"]), ["a_lag1", "a_lag3", "b_lag1", "b_lag3"]),
                        (lambda df: rolling_mean_features(df, SPEC, ["b"]), ["b_roll_avg3"])):
        state, got = None, []
        for new in deliveries(data):
            result, state = with_month(state, new, SPEC, 3, step)
            state = stage_via_parquet(state)
            got += table(result, *SPEC.cell, *names)
            assert state.groupBy(*SPEC.entity).count().where("count > 3").isEmpty()
        assert sorted(got, key=str) == sorted(table(step(data), *SPEC.cell, *names), key=str)


def test_forward_fill_month_by_month_equals_the_whole(data):
    state, got = None, []
    for new in deliveries(data):
        filled, state = fill_forward_month(state, new, SPEC, ["a"])
        state = stage_via_parquet(state)
        got += table(filled, *SPEC.cell, "a")
    assert sorted(got, key=str) == sorted(table(forward_fill(data, SPEC, ["a"]), *SPEC.cell, "a"), key=str)


def test_a_period_is_profiled_from_the_sketches_of_its_months(spark):
    r = random.Random(1)
    rows = [row(e, n, r.choice([None, r.gauss(0, 1), 0.0]), e) for e in range(400) for n in range(6)]
    df = panel(spark, rows)
    sketches = stage_via_parquet(month_sketches(df, SPEC, ["a", "b"]))
    assert sketches.count() == 12
    period = F.col("month").between(F.lit(month(1)), F.lit(month(4)))
    got = {p.feature: p for p in merged_profile(sketches.where(period)).collect()}
    values = sorted(x[9] for x in rows if month(1) <= x[8] <= month(4) and x[9] is not None)
    a, b = got["a"], got["b"]
    assert (a.n, a.nulls, a.zeros) == (len(values), 1600 - len(values), values.count(0.0))
    assert a.low == values[0] and a.high == values[-1] and a.mean == pytest.approx(sum(values) / len(values))
    assert abs(a.distinct - len(set(values))) < 0.06 * len(set(values)) and abs(b.distinct - 400) < 24
    for q in (25, 50, 75):
        at = int(q / 100 * len(values))
        margin = int(0.02 * len(values))
        assert values[at - margin] <= a[f"q{q}"] <= values[at + margin]
    assert merged_profile(sketches.limit(0)).collect() == []


def test_faulty_lines_come_out_with_their_reasons(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,when,x,name\n1,2020-01-31,2.5,"a, b"\n2,31.01.2020,,c\n\n3,2020-13-01,x,d\n4,2020-01-01,1\n')
    (tmp_path / "b.csv").write_text("id,when,x,name\nfive,2020-02-02,1e3,\n6,,7,é\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("when", T.DateType()),
                           T.StructField("x", T.DoubleType()), T.StructField("name", T.StringType())])
    got = scan_csv_checked(spark, str(tmp_path), schema, ("yyyy-MM-dd", "dd.MM.yyyy"))
    day = dt.date(2020, 1, 31)
    assert sorted(map(tuple, got.rows.collect())) == [(1, day, 2.5, "a, b"), (2, day, None, "c"), (6, None, 7.0, "é")]
    faulty = {r.line: (r.file.rpartition("/")[2], r.reasons) for r in got.faulty.collect()}
    assert faulty == {"3,2020-13-01,x,d": ("a.csv", ["when: not a date", "x: not a double"]),
                      "4,2020-01-01,1": ("a.csv", ["number of fields"]),
                      "five,2020-02-02,1e3,": ("b.csv", ["id: not a bigint"])}
    assert {r.reason: r.n for r in got.counts.collect()}["number of fields"] == 1
    assert got.rows.schema.names == schema.names
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "c.csv").write_text("")
    assert all(t.count() == 0 for t in scan_csv_checked(spark, str(tmp_path / "empty"), schema))


def test_an_empty_table_has_a_row_for_each_column(spark, data):
    none = data.where("a > 100")
    rows = {r.feature: r for r in describe_table(none, ["a", "b", "state_name"]).collect()}
    assert set(rows) == {"a", "b", "state_name"}
    assert all((r["count"], r.nulls, r.q50, r.mean) == (0, 0, None, None) for r in rows.values())
    profile = {r.feature: (r["count"], r.missing, r["distinct"]) for r in column_profile(none, ["a", "state_name"]).collect()}
    assert profile == {"a": (0, 0, 0), "state_name": (0, 0, 0)}
    assert [tuple(r) for r in column_median(none, ["a"]).collect()] == [("a", None)]
    assert [tuple(r) for r in column_median(none, ["a"], exact=False).collect()] == [("a", None)]
    assert [tuple(r) for r in percentile_cut(none, "a").collect()] == [(None,)]
