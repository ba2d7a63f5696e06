"""Recurrent reconstruction of sequences: an LSTM autoencoder trained by data-parallel passes.

The encoder reads a window month by month; the decoder starts from its last state, gets zeros as
input and must give the window back. Each pass sends the weights to the tasks, every task adds up
the gradients of its Arrow batches, and the sums of all tasks are added up by shares before they
reach the driver, which takes one step of Adam. Memory is one batch and one gradient per task,
whatever the number of windows.

Hochreiter and Schmidhuber, Neural Computation 9, 1997; Kingma and Ba, ICLR 2015.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paneltide.operators.reconstruct import add_errors

# Size of the state, stacked layers, passes, step and its decay rates.
HIDDEN = 64
LAYERS = 2
PASSES = 50
STEP = 0.01
DECAY = (0.9, 0.999)
SEED = 42
#: Windows in one forward and backward computation, and shares the gradients are added up in first.
WINDOWS_AT_ONCE = 512
SHARES = 16

Weights = dict[str, np.ndarray]

_buffers = threading.local()


def start_weights(width: int, hidden: int = HIDDEN, layers: int = LAYERS, seed: int = SEED) -> Weights:
    """Uniform weights within the inverse root of the state's size."""
    rng = np.random.default_rng(seed)
    bound = hidden ** -0.5
    shapes = {"out": (hidden, width), "out_bias": (width,)}
    for part in ("encoder", "decoder"):
        for k in range(layers):
            read = hidden if k else (width if part == "encoder" else 0)
            shapes |= {f"{part}{k}_in": (read, 4 * hidden), f"{part}{k}_state": (hidden, 4 * hidden),
                       f"{part}{k}_bias": (4 * hidden,)}
    return {name: rng.uniform(-bound, bound, shape) for name, shape in shapes.items()}


def _tanh(x: np.ndarray) -> np.ndarray:
    """In place, by the exponential, which takes a part of the time of numpy's tanh."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    np.divide(-2, x, out=x)
    x += 1
    return x


def _buffer(name: str, *shape: int) -> np.ndarray:
    """An array that the next call of this name takes over: new memory costs as much as the work in it.

    It grows to the largest shape asked for, and a thread has its own.
    """
    size = math.prod(shape)
    flat = _buffers.__dict__.get(name)
    if flat is None or len(flat) < size:
        flat = _buffers.__dict__[name] = np.empty(size)
    return flat[:size].reshape(shape)


def _layer(w: Weights, name: str, x: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, list]:
    """States (months, hidden, windows) of one layer that reads x (months, columns, windows).

    Windows lie side by side, so that every gate is one block of memory. State, columns and a row
    of ones lie below one another, so that one product gives all of a month's gates.
    """
    size, months, n = len(h), len(x), h.shape[1]
    # A sigmoid is 1 / (1 + exp(-z)), and tanh is that of 2 z, doubled, less 1.
    scale = np.repeat([-1.0, -2.0], [3 * size, size])
    read = np.ascontiguousarray(
        (np.vstack([w[f"{name}_state"], w[f"{name}_in"], w[f"{name}_bias"][None]]) * scale).T)
    inputs = _buffer(f"{name} inputs", months + 1, read.shape[1], n)
    gates, cells = _buffer(f"{name} gates", months, 4 * size, n), _buffer(f"{name} cells", months + 1, size, n)
    squashed, part = _buffer(f"{name} squashed", months, size, n), _buffer("part", size, n)
    inputs[0, :size], inputs[:months, size:-1], inputs[:, -1], cells[0] = h, x, 1, c
    with np.errstate(over="ignore"):
        for t in range(months):
            z = np.matmul(read, inputs[t], out=gates[t])
            np.exp(z, out=z)
            z += 1
            np.divide(1, z, out=z)
            i, f, o, g = z.reshape(4, size, n)
            g *= 2
            g -= 1
            np.multiply(f, cells[t], out=cells[t + 1])
            cells[t + 1] += np.multiply(i, g, out=part)
            np.multiply(cells[t + 1], 2, out=squashed[t])
            np.multiply(o, _tanh(squashed[t]), out=inputs[t + 1, :size])
    return inputs[1:, :size], [inputs, gates, cells, squashed]


def _layer_back(w: Weights, name: str, cache: list, d_states: np.ndarray | None, last: list[np.ndarray] | None,
                grads: Weights, d_input: bool) -> list[np.ndarray | None]:
    """Gradients of the layer's input, if wanted, and of its first state; adds those of its weights.

    ``last`` holds the gradients of its last state; None stands for zeros.
    """
    inputs, gates, cells, squashed = cache
    months, size, n = squashed.shape
    d_x = _buffer(f"{name} d_x", months, inputs.shape[1] - size - 1, n) if d_input else None
    d_h, d_c = _buffer(f"{name} d_h", size, n), _buffer(f"{name} d_c", size, n)
    d_h[:], d_c[:] = last or (0, 0)
    d_z, part = _buffer("d_z", 4 * size, n), _buffer("part", size, n)
    to_input, to_state, squares = d_z.reshape(4, size, n)[:2], d_z.reshape(4, size, n)[2], d_z[:3 * size]
    total = np.zeros((inputs.shape[1], 4 * size))
    for t in reversed(range(months)):
        i, f, o, g = gates[t].reshape(4, size, n)
        if d_states is not None:
            d_h += d_states[t]
        np.multiply(squashed[t], squashed[t], out=part)
        np.subtract(1, part, out=part)
        part *= o
        part *= d_h
        d_c += part
        np.subtract(1, gates[t, :3 * size], out=squares)
        squares *= gates[t, :3 * size]
        to_input[0] *= np.multiply(d_c, g, out=part)
        to_input[1] *= np.multiply(d_c, cells[t], out=part)
        to_state *= np.multiply(d_h, squashed[t], out=part)
        np.multiply(g, g, out=part)
        np.subtract(1, part, out=part)
        part *= i
        np.multiply(part, d_c, out=d_z[3 * size:])
        total += inputs[t] @ d_z.T
        if d_input:
            np.matmul(w[f"{name}_in"], d_z, out=d_x[t])
        np.matmul(w[f"{name}_state"], d_z, out=d_h)
        d_c *= f
    grads[f"{name}_state"] += total[:size]
    grads[f"{name}_in"] += total[size:-1]
    grads[f"{name}_bias"] += total[-1]
    return [d_x, d_h, d_c]


def _forward(w: Weights, x: np.ndarray) -> tuple[np.ndarray, dict]:
    """What the network gives back for x (months, columns, windows)."""
    layers = sum(name.startswith("encoder") and name.endswith("_bias") for name in w)
    hidden, months, n = len(w["out"]), len(x), x.shape[2]
    caches, last, read = {}, [], x
    for k in range(layers):
        read, caches[f"encoder{k}"] = _layer(w, f"encoder{k}", read, np.zeros((hidden, n)), np.zeros((hidden, n)))
        last.append((read[-1], caches[f"encoder{k}"][2][-1]))
    read = np.zeros((months, 0, n))
    for k in range(layers):
        read, caches[f"decoder{k}"] = _layer(w, f"decoder{k}", read, *last[k])
    caches["top"] = read
    return w["out"].T @ read + w["out_bias"][:, None], caches


def _side_by_side(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.transpose(1, 2, 0))


def rebuild(w: Weights, x: np.ndarray) -> np.ndarray:
    """The windows (windows, months, columns) as the network gives them back."""
    return _forward(w, _side_by_side(x))[0].transpose(2, 0, 1)


def gradients(w: Weights, x: np.ndarray) -> tuple[float, Weights]:
    """The summed squared error of windows (windows, months, columns) and its gradients."""
    x = _side_by_side(x)
    out, caches = _forward(w, x)
    rest = out - x
    grads = {name: np.zeros_like(v) for name, v in w.items()}
    d_out = 2 * rest
    top = caches["top"]
    grads["out"] = (top @ d_out.transpose(0, 2, 1)).sum(axis=0)
    grads["out_bias"] = d_out.sum(axis=(0, 2))
    d_states = w["out"] @ d_out
    layers = sum(name.startswith("decoder") for name in caches)
    first = {}
    for k in reversed(range(layers)):
        d_states, *first[k] = _layer_back(w, f"decoder{k}", caches[f"decoder{k}"], d_states, None, grads, k > 0)
    for k in reversed(range(layers)):
        d_states, *_ = _layer_back(w, f"encoder{k}", caches[f"encoder{k}"], d_states, first[k], grads, k > 0)
    return float((rest * rest).sum()), grads


@dataclass
class Adam:
    """Steps of Adam over all weights, in the order of their names."""

    step: float
    number: int = 0
    mean: np.ndarray | float = 0.0
    square: np.ndarray | float = 0.0

    def __call__(self, w: Weights, gradient: np.ndarray) -> Weights:
        self.number += 1
        self.mean = DECAY[0] * self.mean + (1 - DECAY[0]) * gradient
        self.square = DECAY[1] * self.square + (1 - DECAY[1]) * gradient ** 2
        mean, square = (x / (1 - d ** self.number) for x, d in zip((self.mean, self.square), DECAY, strict=True))
        change, new, at = self.step * mean / (np.sqrt(square) + 1e-8), {}, 0
        for name, v in w.items():
            new[name] = v - change[at:at + v.size].reshape(v.shape)
            at += v.size
        return new


def flat(grads: Weights) -> np.ndarray:
    return np.concatenate([g.ravel() for g in grads.values()])


@dataclass(frozen=True)
class RecurrentReconstruction:
    """Weights of a network for windows of ``length`` months of some indicators, and the mean
    squared error before each pass."""

    indicators: tuple[str, ...]
    length: int
    weights: Weights
    errors: tuple[float, ...]


def _windows(column: pa.Array, length: int, width: int) -> Iterator[np.ndarray]:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length, width)
    for at in range(0, len(x), WINDOWS_AT_ONCE):
        yield x[at:at + WINDOWS_AT_ONCE]


def _row(share: int, n: int, loss: float, gradient: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([share], pa.int32()), pa.array([n]), pa.array([loss]), pa.array([gradient], pa.list_(pa.float64()))],
        names=["share", "n", "loss", "gradient"])


def _task_sums(weights, length: int, width: int) -> Callable:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        w = weights.value
        n, loss, total = 0, 0.0, {name: np.zeros_like(v) for name, v in w.items()}
        for batch in batches:
            for x in _windows(batch.column(0), length, width):
                own, grads = gradients(w, x)
                n, loss = n + len(x), loss + own
                for name, g in grads.items():
                    total[name] += g
        if n:
            yield _row(TaskContext.get().partitionId() % SHARES, n, loss, flat(total))

    return sums


def _share_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, loss, total = 0, 0.0, None
    for batch in batches:
        for i in range(len(batch)):
            own = batch.column("gradient")[i].values.to_numpy(zero_copy_only=False)
            total = own.copy() if total is None else total + own
            n, loss = n + batch.column("n")[i].as_py(), loss + batch.column("loss")[i].as_py()
    if total is not None:
        yield _row(0, n, loss, total)


def recurrent_fit(windows: DataFrame, indicators: Sequence[str], length: int, hidden: int = HIDDEN,
                  layers: int = LAYERS, passes: int = PASSES, step: float = STEP, seed: int = SEED,
                  features: str = "features") -> RecurrentReconstruction:
    """Fit on windows flattened to array<double> (months in order, indicators within a month).

    Every pass reads ``windows``: pass a staged table. Windows with a null are an error; without
    any windows the network keeps its first weights.
    """
    width, spark = len(indicators), windows.sparkSession
    w = start_weights(width, hidden, layers, seed)
    adam, errors = Adam(step), []
    column = windows.select(features)
    schema = "share int, n long, loss double, gradient array<double>"
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(w)
        added = (column.mapInArrow(_task_sums(shared, length, width), schema)
                 .repartition(SHARES, "share").mapInArrow(_share_sums, schema).collect())    # SHARES rows at most
        shared.destroy()
        if not added:
            break
        n = sum(r["n"] for r in added) * length * width
        errors.append(sum(r["loss"] for r in added) / n)
        w = adam(w, np.sum([r["gradient"] for r in added], axis=0) / n)
    return RecurrentReconstruction(tuple(indicators), length, w, tuple(errors))


def recurrent_score(windows: DataFrame, model: RecurrentReconstruction, features: str = "features",
                    name: str = "error") -> DataFrame:
    """Add the error of each window, as ``reconstruction_score`` does."""
    length, width = model.length, len(model.indicators)
    shared = windows.sparkSession.sparkContext.broadcast(model.weights)

    @F.arrow_udf("array<double>")
    def squared(rows: pa.Array) -> pa.Array:
        per = [((rebuild(shared.value, x) - x) ** 2).sum(axis=1) for x in _windows(rows, length, width)]
        errors = np.concatenate(per) if per else np.zeros((0, width))
        offsets = np.arange(len(errors) + 1, dtype=np.int32) * width
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(errors.ravel()))

    return add_errors(windows, squared(F.col(features)), model.indicators, length, name)
