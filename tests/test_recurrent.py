"""The recurrent autoencoder: gradients, passes over Spark, scores, and what it learns."""

import math

import numpy as np
import pytest

from paneltide.operators import recurrent
from paneltide.operators.recurrent import (
    Adam, RecurrentReconstruction, flat, gradients, rebuild, recurrent_fit, recurrent_score, start_weights,
)

LENGTH, WIDTH = 12, 1


def curved(n, seed=0):
    """Waves of different lengths and phases: far from a flat subspace."""
    rng = np.random.default_rng(seed)
    speed, phase = rng.uniform(0.2, 1.3, (2, n, 1))
    return np.sin(speed * np.arange(LENGTH) + 5 * phase)[:, :, None]


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    w, x = start_weights(2, 3, 2, seed=1), rng.normal(size=(4, 5, 2))
    grads = gradients(w, x)[1]
    for name, g in grads.items():
        for at in rng.integers(0, g.size, 4) if g.size else ():
            moved = {k: v.copy() for k, v in w.items()}
            ends = []
            for change in (1e-5, -2e-5):
                moved[name].ravel()[at] += change
                ends.append(gradients(moved, x)[0])
            assert g.ravel()[at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-4, abs=1e-6), name


def plain_pass(w, window, hidden, layers):
    """One window, one number at a time."""
    def cell(name, x, h, c):
        z = [sum(a * w[f"{name}_in"][k][j] for k, a in enumerate(x)) + sum(
            a * w[f"{name}_state"][k][j] for k, a in enumerate(h)) + w[f"{name}_bias"][j] for j in range(4 * hidden)]
        gate = lambda v: 1 / (1 + math.exp(-v))
        c = [gate(z[hidden + j]) * c[j] + gate(z[j]) * math.tanh(z[3 * hidden + j]) for j in range(hidden)]
        return [gate(z[2 * hidden + j]) * math.tanh(c[j]) for j in range(hidden)], c

    state = [([0.0] * hidden, [0.0] * hidden) for _ in range(layers)]
    for x in window:
        for k in range(layers):
            state[k] = cell(f"encoder{k}", x, *state[k])
            x = state[k][0]
    out = []
    for _ in window:
        x = []
        for k in range(layers):
            state[k] = cell(f"decoder{k}", x, *state[k])
            x = state[k][0]
        out.append([sum(a * w["out"][j][i] for j, a in enumerate(x)) + w["out_bias"][i] for i in range(len(w["out_bias"]))])
    return out


def test_scores_equal_a_plain_pass(spark):
    w = start_weights(2, 3, 2, seed=5)
    x = np.random.default_rng(1).normal(size=(30, 4, 2))
    rows = [(i, v.ravel().tolist()) for i, v in enumerate(x)]
    model = RecurrentReconstruction(("a", "b"), 4, w, ())
    got = recurrent_score(spark.createDataFrame(rows, "i int, features array<double>").repartition(3), model).collect()
    assert len(got) == 30
    for r in got:
        rest = np.array(plain_pass(w, x[r.i].tolist(), 3, 2)) - x[r.i]
        per = (rest ** 2).sum(axis=0)
        assert r.error == pytest.approx((rest ** 2).mean())
        assert r.error_indicator == "ab"[per.argmax()]
        assert r.error_share["a"] == pytest.approx(per[0] / per.sum())


def test_passes_over_spark_equal_local_steps(spark):
    x = curved(200)
    df = spark.createDataFrame([(v.ravel().tolist(),) for v in x], "features array<double>").repartition(5)
    model = recurrent_fit(df, ["a"], LENGTH, hidden=4, layers=2, passes=3, step=0.02, seed=9)
    w, adam, errors = start_weights(1, 4, 2, 9), Adam(0.02), []
    for _ in range(3):
        loss, grads = gradients(w, x)
        errors.append(loss / x.size)
        w = adam(w, flat(grads) / x.size)
    assert model.errors == pytest.approx(errors) and errors[2] < errors[0]
    for name, v in w.items():
        assert np.allclose(model.weights[name], v, atol=1e-7)
    none = recurrent_fit(df.limit(0), ["a"], LENGTH, hidden=4, layers=1, passes=2)
    assert none.errors == ()


def test_it_learns_what_a_plane_of_its_size_cannot():
    x, new = curved(400), curved(200, seed=1)
    hidden = 4                                          # its state: 2 x 4 numbers, against 4 components
    w, adam = start_weights(1, hidden, 1, 2), Adam(0.02)
    for _ in range(1500):
        w = adam(w, flat(gradients(w, x)[1]) / x.size)
    plane = x[:, :, 0]
    mean = plane.mean(axis=0)
    axes = np.linalg.svd(plane - mean, full_matrices=False)[2][:hidden]
    rest = (new[:, :, 0] - mean) - (new[:, :, 0] - mean) @ axes.T @ axes
    assert ((rebuild(w, new) - new) ** 2).mean() < (rest ** 2).mean()


def test_windows_side_by_side_at_extremes_and_any_number():
    """Gates far out neither overflow nor lose their limit; the number taken at once doesn't matter."""
    assert recurrent._tanh(2 * np.array([-1e6, -30.0, 0.0, 1e-3, 30.0, 1e6])) == pytest.approx(
        np.tanh([-1e6, -30.0, 0.0, 1e-3, 30.0, 1e6]), abs=1e-15)
    w, x = start_weights(2, 5, 2, seed=4), np.random.default_rng(6).normal(size=(9, 7, 2))
    whole, parts = gradients(w, x), [gradients(w, x[i:i + 2]) for i in range(0, 9, 2)]
    assert whole[0] == pytest.approx(sum(p[0] for p in parts))
    assert np.allclose(flat(whole[1]), sum(flat(p[1]) for p in parts), atol=1e-12)


def test_a_layer_takes_over_the_memory_of_the_last_call():
    """New memory cost as much as the work in it; what was given back before stays as it was."""
    w, rng = start_weights(2, 5, 2, seed=4), np.random.default_rng(6)
    x, other = rng.normal(size=(9, 7, 2)), rng.normal(size=(40, 7, 2))
    loss, grads = gradients(w, x)
    back, kept = rebuild(w, x), {name: g.copy() for name, g in grads.items()}
    copy = back.copy()
    gradients(w, other)
    held = {name: id(v) for name, v in vars(recurrent._buffers).items()}
    for v in (other, x, other[:1]):
        gradients(w, v)
    assert held and held == {name: id(v) for name, v in vars(recurrent._buffers).items()}
    assert (back == copy).all() and all((grads[name] == v).all() for name, v in kept.items())
    again = gradients(w, x)
    assert again[0] == loss and (flat(again[1]) == flat(grads)).all()
