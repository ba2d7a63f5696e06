import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneltide.operators import quantiles as Q
from paneltide.operators.quantiles import percentile_cut, quantile_table

QS = [0.0, 0.2, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    n = 5000
    rows = [(rng.gauss(0, 1e6), 0.0 if rng.random() < 0.6 else rng.random(),
             None if rng.random() < 0.3 else rng.randrange(5), 7, None)
            for _ in range(n)]
    return spark.createDataFrame(rows, "wide double, mostly_zero double, few int, same int, "
                                       "nothing double").repartition(7).cache()


@pytest.mark.parametrize("limits", [{}, {"max_rows": 10, "max_bracket": 20},
                                    {"max_rows": 10, "max_bracket": 1}])
def test_exact_quantiles_equal_numpy(values, limits):
    cols = ["wide", "mostly_zero", "few", "same", "nothing"]
    got = dict(quantile_table(values, cols, QS, **limits).collect())
    for c in cols:
        data = np.array([r[0] for r in values.select(c).where(F.col(c).isNotNull()).collect()], float)
        if not len(data):
            assert got[c] is None or all(v is None for v in got[c])
        else:
            np.testing.assert_allclose(got[c], np.quantile(data, QS), rtol=1e-12, atol=1e-12)


def test_approximate_quantiles_are_near(values):
    got = quantile_table(values, ["wide"], [0.5], exact=False).first()["values"][0]
    data = np.array([r[0] for r in values.select("wide").collect()])
    assert abs((data <= got).mean() - 0.5) < 0.01


def test_percentile_cut(values):
    data = np.array([r[0] for r in values.select("wide").collect()])
    assert percentile_cut(values, "wide").first()[0] == pytest.approx(np.percentile(data, 20))


def test_brackets_keep_exact_values_of_any_size(spark):
    data = [-math.inf, -1e300, -2.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0 + 2 ** -52, 3e200, math.inf] * 3
    df = spark.createDataFrame([(x,) for x in data], "x double").repartition(4)
    qs = [k / 32 for k in range(33)]       # the ranks themselves
    got = quantile_table(df, ["x"], qs, max_rows=1, max_bracket=1).first()["values"]
    assert got == sorted(data)


def test_a_bracket_takes_one_pass_per_bin_bits(spark, monkeypatch):
    """Ties and far-off values cost no more passes: a bracket shrinks by a fixed factor."""
    passes, narrow = [], Q._narrow
    monkeypatch.setattr(Q, "_narrow", lambda *a: passes.append(1) or narrow(*a))
    rows = [(float(i % 3),) for i in range(999)] + [(1e308,), (-1e308,)]
    df = spark.createDataFrame(rows, "x double").repartition(4)
    assert quantile_table(df, ["x"], [0.5], max_rows=1, max_bracket=10).first()["values"] == [1.0]
    assert 1 <= len(passes) <= -(-64 // Q.BIN_BITS)
