"""Statistics, scaling, forests and reconstruction: exact values and invariants."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frames import SPEC, month, panel, row
from paneltide.operators import importance as M
from paneltide.operators import isolation as A
from paneltide.operators import profile as P
from paneltide.operators import reconstruct as R
from paneltide.operators import scale as Z
from paneltide.operators import sequences as S
from paneltide.operators import stats as T
from paneltide.plans import anomaly
from paneltide.sources import io


@pytest.fixture(scope="module")
def related(spark):
    rng = np.random.default_rng(1)
    n = 400
    x = rng.normal(size=n)
    frame = pd.DataFrame({"x": x, "same": 3 * x + 1, "against": -x + 0.05 * rng.normal(size=n),
                          "half": 0.5 * x + rng.normal(size=n), "flat": 2.0,
                          "tiny": 0.01 * rng.normal(size=n), "other": rng.normal(size=n)})
    frame.loc[rng.random(n) < 0.2, "half"] = np.nan
    frame.loc[rng.random(n) < 0.1, "x"] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r)
            for r in frame.itertuples(index=False, name=None)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in frame))
    return frame, df


def test_correlation_equals_pandas(related):
    frame, df = related
    got = {(r.col_a, r.col_b): (r.r, r.n) for r in T.correlation_matrix(df, list(frame)).collect()}
    expected = frame.corr()
    assert len(got) == len(frame.columns) ** 2
    for a in frame:
        for b in frame:
            r, n = got[a, b]
            assert n == (frame[a].notna() & frame[b].notna()).sum()
            if "flat" in (a, b):
                assert r is None
            else:
                assert r == pytest.approx(expected.loc[a, b], abs=1e-12)


def test_filter_policies(related):
    frame, df = related
    assert set(T.filter_features(df, list(frame)).columns) == {"half", "other"}
    assert set(T.filter_features(df, list(frame), policy="keep_first").columns) == {"x", "half", "other"}
    with pytest.raises(ValueError):
        T.filter_features(df, list(frame), policy="other")


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (9.0, 5.0)], "x double, c double")
    got = [tuple(r) for r in Z.standard_scale(df, ["x", "c"]).collect()]
    x = np.array([1, 2, 9.0])
    np.testing.assert_allclose([g[0] for g in got], (x - x.mean()) / x.std())
    assert {g[1] for g in got} == {0.0}
    train = df.where("x < 5")
    got = [tuple(r) for r in Z.minmax_scale(df, ["x", "c"], train).collect()]
    assert [g[0] for g in got] == [0.0, 1.0, 8.0]
    assert {g[1] for g in got} == {0.0}


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (0, None), (None, "a"), (1, "a")], "x int, t string")
    got = {r.feature: r for r in P.column_profile(df).collect()}
    assert got["x"]["count"] == 4
    assert (got["x"].missing, got["x"].distinct, got["x"].zeros, got["x"].type) == (1, 2, 1, "int")
    assert (got["t"].missing, got["t"].distinct, got["t"].min_text, got["t"].max_text) == (1, 2, "a", "b")
    rough = {r.feature: r for r in P.column_profile(df, exact=False).collect()}
    assert rough["x"].distinct == 2
    top = {(r.feature, r.rank): (r.number, r.text, r.n) for r in P.column_top_values(df, ["x", "t"]).collect()}
    assert top["x", 1] == (1.0, None, 3) and top["t", 1] == (None, "a", 3)
    bins = P.column_histogram(df, ["x"], bins=2).collect()
    assert {(r.bin, r.n) for r in bins} == {(0, 1), (1, 3)}
    assert P.duplicate_rows(df).first() == (1, 1)


@pytest.fixture(scope="module")
def crowd(spark):
    """A cloud of ordinary rows and one far away."""
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(1500)] + [(9999, 9.0, -9.0, 9.0)]
    return spark.createDataFrame(rows, "k int, x double, y double, z double").cache()


def scores(df, **kwargs):
    cols = ["x", "y", "z"]
    forest = A.Forest.from_table(A.isolation_forest_fit(df, ["k"], cols, **kwargs), cols)
    got = A.isolation_forest_score(df, forest).select("k", "score").collect()
    return forest, {r.k: r.score for r in got}


def test_isolation_forest(crowd):
    forest, one = scores(crowd.repartition(2))
    _, two = scores(crowd.repartition(8))
    assert one == two
    assert all(-0.5 <= s <= 0.5 for s in one.values())
    assert one[9999] == min(one.values())
    assert forest.feature.shape == (100, 511)


def test_isolation_forest_scores_follow_the_nodes(crowd):
    """The array form gives the path a walk through the node table gives."""
    cols = ["x", "y", "z"]
    model = A.isolation_forest_fit(crowd, ["k"], cols, trees=7, rows=64).cache()
    nodes = {(r.tree, r.node): r for r in model.collect()}
    forest = A.Forest.from_table(model, cols)
    got = {r.k: r for r in A.isolation_forest_score(crowd, forest).collect()}
    for k in (0, 17, 9999):
        x = [got[k][c] for c in cols]
        depth = 0.0
        for t in range(7):
            i = 0
            while nodes[t, i].feature >= 0:
                i = 2 * i + 1 + (x[nodes[t, i].feature] > nodes[t, i].threshold)
            depth += nodes[t, i].depth
        assert got[k].score == pytest.approx(0.5 - 2 ** (-(depth / 7) / A.mean_path(64)))


def test_tree_samples(crowd):
    cols = ["x", "y", "z"]
    small = A.tree_samples(crowd, ["k"], cols)
    sizes = {r.tree: (r.n, r.d) for r in small.groupBy("tree").agg(
        F.count("*").alias("n"), F.count_distinct("x").alias("d")).collect()}
    assert sizes == {t: (256, 256) for t in range(100)}
    few = A.tree_samples(crowd, ["k"], cols, trees=5, rows=64)
    assert few.count() == 320 and few.distinct().count() == 320
    tiny = A.tree_samples(crowd.limit(10), ["k"], cols, trees=3)
    assert {r["count"] for r in tiny.groupBy("tree").count().collect()} == {10}
    copies = A.tree_samples(crowd.withColumn("k", F.lit(1)), (), cols, trees=5, rows=64)
    assert copies.count() == 320


def test_pseudo_label(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("score"))
    assert A.pseudo_label(df).agg(F.sum("pseudo_label")).first()[0] == 20


@pytest.fixture(scope="module")
def driven(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.normal(size=5))) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, n1 double, n2 double, key double, n3 double, n4 double")
    return df.withColumn("pseudo_label", (F.col("key") > 0.8).cast("int")).cache()


def test_importances(driven):
    cols = ["n1", "n2", "key", "n3", "n4"]
    got = M.forest_importance(driven, cols, trees=20).cache()
    assert got.agg(F.sum("importance")).first()[0] == pytest.approx(1)
    assert M.top_k_features(got, 1).first().feature == "key"
    assert M.select_top_features(driven, got, ["k"], 1).columns == ["k", "key"]


def test_permutation_importance(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.normal()), 1.0, float(rng.normal() if i % 50 else 30)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, x double, same double, spiky double")
    cols = ["x", "same", "spiky"]
    forest = A.Forest.from_table(A.isolation_forest_fit(df, ["k"], cols, trees=30), cols)
    got = {r.feature: r.mean_abs_change for r in A.permutation_importance(df, forest, ["k"]).collect()}
    assert got["same"] == 0 and got["x"] > 0 and got["spiky"] > 0
    using = A.trees_by_feature(forest)
    assert using[1] == [] and sum(map(len, using)) < 3 * 30      # fewer walks than all trees each


def test_rescoring_the_trees_of_a_feature_is_rescoring_all():
    rng = np.random.default_rng(1)
    feature = rng.integers(0, 3, (9, 7))
    feature[:4][feature[:4] == 2] = 0
    threshold = rng.normal(size=(9, 7))
    forest = A.Forest(("a", "b", "c"), feature, threshold, rng.uniform(1, 5, (9, 4)), 4.0)
    score, x = A._scorer(forest), rng.normal(size=(50, 3))
    changed = x.copy()
    changed[:, 2] = rng.normal(size=50)
    own = A.trees_by_feature(forest)[2]
    assert 0 < len(own) <= 5
    base = A._paths(forest.nodes, x, range(9))
    total = base.sum(axis=0) + (A._paths(forest.nodes, changed, own) - base[own]).sum(axis=0)
    assert np.allclose(0.5 - 2.0 ** (-(total / 9) / 4.0), score(forest.nodes, changed))


@pytest.mark.parametrize("n", [100, 400, 30_000])
def test_every_tree_has_the_rows_of_its_lowest_hashes(spark, n):
    df = spark.range(n).selectExpr("id as k", "id * 2 as x")
    one, other = ({(r.tree, r.draw, r.x[0]) for r in A.tree_samples(d, ["k"], ["x"], 5, 64).collect()}
                  for d in (df, df.repartition(3)))
    assert one == other
    per = [{x for t, _, x in one if t == tree} for tree in range(5)]
    assert all(len(p) == 64 for p in per) and len(set.union(*per)) > 64


@pytest.fixture(scope="module")
def waves(spark):
    rng = random.Random(1)
    rows = [row(e, n, float(np.sin(n / 2) + e + 0.01 * rng.random()), int(10 * np.cos(n)))
            for e in range(6) for n in range(48)]
    rows[40] = row(0, 40, 50.0, 3)
    return panel(spark, rows).cache()


def test_reconstruction(waves):
    cols = ["a", "b"]
    windows = S.flatten_window(S.sequence_window(waves, SPEC, cols), cols).cache()
    errors = []
    for k in (1, 4, 24):
        model = R.reconstruction_fit(windows, cols, 12, k)
        scored = R.reconstruction_score(windows, model)
        errors.append(scored.agg(F.avg("error")).first()[0])
    assert errors[0] >= errors[1] >= errors[2] and errors[2] == pytest.approx(0, abs=1e-12)
    model = R.reconstruction_fit(windows.where("subdistrict_code > 0"), cols, 12, 6)
    worst = R.reconstruction_score(windows, model).orderBy(F.desc("error")).first()
    assert worst.subdistrict_code == 0 and worst.error_indicator == "a"
    assert sum(worst.error_share.values()) == pytest.approx(1)
    assert model.table(waves.sparkSession).count() == 6 * 24


def test_plan_end_to_end(spark, waves):
    gappy = waves.where(~((F.col("subdistrict_code") == 3) & (F.col("date") == F.lit(month(20)))))
    ready = anomaly.prepare_panel(gappy, SPEC)
    assert ready.count() == 6 * 48 and ready.where("a is null or b is null").count() == 0
    top = anomaly.select_indicators(ready, SPEC, k=1)
    assert top.count() == 1
    scored = anomaly.score_sequences(ready, SPEC, ["a", "b"], dt.date(2018, 12, 31), dt.date(2019, 12, 31), k=4)
    out = {r["split"]: r for r in anomaly.evaluate_sequences(scored).collect()}
    assert set(out) == {"train", "val", "test"}
    assert sum(r.n_windows for r in out.values()) == 6 * 37


def test_single_file_and_round_trip(spark, waves, tmp_path):
    small = waves.groupBy("date").agg(F.sum("a").alias("s"))
    io.sink_csv_single(small, str(tmp_path / "one"), ["date"])
    assert len(list((tmp_path / "one").glob("*.csv"))) == 1
    back = io.scan_csv(spark, str(tmp_path / "one"), small.schema)
    assert [r.date for r in back.collect()] == sorted(r.date for r in small.collect())


def test_large_report_in_sorted_files(spark, waves, tmp_path):
    io.sink_csv_single(waves.select("id"), str(tmp_path / "many"), ["id"], single=False)
    assert io.scan_csv(spark, str(tmp_path / "many")).count() == waves.count()
