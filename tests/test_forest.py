"""The two-phase forest: purity, exactness of a subtree, and what it must not depend on."""

import numpy as np
import pytest

from paneltide.operators import forest
from paneltide.operators.forest import _subtree, _Tree, bootstrap_weights, impurity_decreases
from paneltide.operators.importance import forest_importance

COLS = ["driver", "helper", "noise", "flat"]


def data(spark, n=1500):
    rng = np.random.default_rng(8)
    driver, helper, noise = rng.normal(size=(3, n))
    label = ((driver > 0.3) | ((helper > 1.2) & (noise > -2))).astype(int)
    rows = [(i, int(y), float(a), float(b), float(c), 1.0)
            for i, (y, a, b, c) in enumerate(zip(label, driver, helper, noise))]
    return spark.createDataFrame(rows, "id long, pseudo_label int, driver double, helper double, noise double, flat double")


def gini(y, w):
    total = sum(w)
    return total - sum(sum(b for a, b in zip(y, w) if a == c) ** 2 for c in set(y)) / total if total else 0.0


def test_a_subtree_takes_the_best_cut_until_leaves_are_pure():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x = rng.integers(0, 6, (30, 1)).astype(float)
        y, w = rng.integers(0, 3, 30), rng.integers(1, 4, 30)

        def grow(rows):
            cuts = sorted({x[i, 0] for i in rows})[:-1]
            own = lambda r: gini([y[i] for i in r], [w[i] for i in r])
            if len({y[i] for i in rows}) < 2 or not cuts:
                return 0.0
            gains = []
            for c in cuts:
                low, high = [i for i in rows if x[i, 0] <= c], [i for i in rows if x[i, 0] > c]
                gains.append((own(rows) - own(low) - own(high), low, high))
            gain, low, high = max(gains, key=lambda g: round(g[0], 9))
            return gain + grow(low) + grow(high)

        got = _subtree(x, y, w, 3, np.random.default_rng(0))
        # With one feature the leaves are the distinct values, whatever the order of the cuts.
        assert got[0] == pytest.approx(grow(list(range(30))))


def test_weights_are_poisson_and_follow_the_row():
    ticket = np.random.default_rng(2).integers(-2 ** 62, 2 ** 62, 200_000)
    w = bootstrap_weights(ticket, 3, 42)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005
    assert (bootstrap_weights(ticket[:50], 3, 42) == w[:50]).all()
    other = bootstrap_weights(ticket, 4, 42)
    assert abs(np.corrcoef(w, other)[0, 1]) < 0.01


def test_routing_follows_the_cuts():
    tree = _Tree()
    left = tree.split(0, 1, 4)
    tree.split(left, 0, 2)
    bins = np.array([[2, 4], [3, 4], [0, 5]])
    assert tree.route(bins).tolist() == [3, 4, 2]


@pytest.mark.parametrize("small", [forest.SMALL_ROWS, 60])
def test_importances_depend_on_rows_alone(spark, small):
    df = data(spark)
    found = [impurity_decreases(df.repartition(n), COLS, "pseudo_label", 6, 42, ["id"], small) for n in (1, 7)]
    assert (found[0] == found[1]).all()
    # All impurity is taken away where leaves are pure: it is the same for any order of cuts.
    ticket = {r.id: r.t for r in df.selectExpr("id", "xxhash64(42, id) as t").collect()}
    rows = df.collect()
    for t in range(6):
        w = bootstrap_weights(np.array([ticket[r.id] for r in rows]), t, 42)
        assert found[0][t].sum() == pytest.approx(gini([r.pseudo_label for r in rows], w.tolist()))
    assert (found[0].argmax(axis=1) == 0).all() and (found[0][:, 3] == 0).all()


def test_importance_table(spark):
    got = {r.feature: r.importance for r in forest_importance(data(spark), COLS, trees=10, small_rows=200).collect()}
    assert max(got, key=got.get) == "driver" and got["flat"] == 0
    assert sum(got.values()) == pytest.approx(1)
    one = data(spark).where("pseudo_label = 1")
    assert {r.importance for r in forest_importance(one, COLS, trees=3).collect()} == {0.0}
    assert len(forest_importance(one.limit(0), COLS, trees=3).collect()) == 4


def test_large_nodes_of_all_trees_share_their_passes(spark, monkeypatch):
    passes, counted = [], forest._counted
    monkeypatch.setattr(forest, "_counted", lambda rows, trees, wanted, *a: passes.append(
        {t for t, _ in wanted}) or counted(rows, trees, wanted, *a))
    whole = impurity_decreases(data(spark, 600), COLS, "pseudo_label", 5, 42, ["id"], 150)
    assert passes[0] == set(range(5)) and len(passes) < 20
    first = len(passes)
    monkeypatch.setattr(forest, "ROWS_AT_ONCE", 1)       # subtrees of one tree at a time
    assert (impurity_decreases(data(spark, 600), COLS, "pseudo_label", 5, 42, ["id"], 150) == whole).all()
    assert len(passes) == 2 * first


def test_rows_of_a_node_cross_whole():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(7, 3)), rng.integers(0, 3, 7), rng.integers(1, 9, 7), rng.integers(-2 ** 62, 2 ** 62, 7)
    assert all((a == b).all() for a, b in zip(rows, forest._unpacked(forest._packed(*rows)), strict=True))


@pytest.mark.parametrize("at_a_time", [forest.BINNED_AT_ONCE, 1])
def test_one_task_splits_the_large_nodes_of_a_tree_as_the_passes_do(spark, monkeypatch, at_a_time):
    passes, counted = [], forest._counted
    monkeypatch.setattr(forest, "_counted", lambda *a: passes.append(1) or counted(*a))
    monkeypatch.setattr(forest, "BINNED_AT_ONCE", at_a_time)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 70)
    monkeypatch.setattr(forest, "BYTES_AT_ONCE", 3_000)
    df = data(spark, 900).repartition(3)
    whole = impurity_decreases(df, COLS, "pseudo_label", 4, 42, ["id"], 40)
    assert len(passes) == 1                              # the bins of a tree fit one task at once
    monkeypatch.setattr(forest, "BINNED_ROWS", 300)      # some passes, then one task
    assert (impurity_decreases(df, COLS, "pseudo_label", 4, 42, ["id"], 40) == whole).all()
    some = len(passes) - 1
    monkeypatch.setattr(forest, "BINNED_ROWS", 0)        # passes only
    assert (impurity_decreases(df, COLS, "pseudo_label", 4, 42, ["id"], 40) == whole).all()
    assert len(passes) - 1 - some > some > 1


def test_a_subtree_does_not_depend_on_the_order_of_rows():
    rng = np.random.default_rng(7)
    for classes in (2, 3, 5):
        x, y, w = rng.integers(0, 9, (300, 5)) / 3.0, rng.integers(0, classes, 300), rng.integers(1, 5, 300)
        order = rng.permutation(300)
        got = [_subtree(x[o], y[o], w[o], classes, np.random.default_rng(1)) for o in (np.arange(300), order)]
        assert (got[0] == got[1]).all() and got[0].sum() > 0
