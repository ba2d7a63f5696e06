"""Random forests of unlimited depth, grown in two phases.

While a node holds many rows, it is split level by level: every task routes its rows through the
trees so far and counts them by node, feature, bin and class; the counts are added up by Spark and
the best bin border splits the node. Once such nodes of a tree hold at most ``BINNED_ROWS`` rows
together, the bins of these go to one task, which splits on in the same way without further passes.
Once a node holds at most ``SMALL_ROWS`` rows, these go to one task, which grows the subtree below
it to purity on exact values.

Nothing depends on how rows are dealt: a row's weight in a tree follows from a hash of its key, bin
borders come from the rows with the lowest hashes, counts are whole numbers, a subtree is grown from
counts alone, and decreases of impurity are added up in the order of nodes or as decimals.

Breiman, Random Forests, Machine Learning 45, 2001.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A node of at most so many rows (counted with their weights) is finished in one task.
SMALL_ROWS = 100_000
#: Large nodes of a tree with at most so many rows together are split in one task: a byte per row and
#: feature there.
BINNED_ROWS = 8_000_000
#: Bins of a feature in large nodes, and the rows their borders are taken from.
BINS = 128
BORDER_ROWS = 50_000
#: Counts of one pass over the rows, and rows sent to subtrees or, binned, to trees at a time: they
#: bound how many nodes are split and how many trees are finished together. Rows are those of up to
#: eight features, fewer of more.
COUNTS_AT_ONCE = 4_000_000
ROWS_AT_ONCE = 80_000_000
BINNED_AT_ONCE = 500_000_000
#: Rows a task deals to trees at a time, bytes it gives away at a time, and the tasks these go to.
BLOCK_ROWS = 32_768
BYTES_AT_ONCE = 16_000_000
PARTS = 64
#: Classes a label may have.
MAX_CLASSES = 100

_HALF = (1 << 32) - 1
_DECREASE = "tree int, feature int, decrease double"


def _mix(x: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


# The chances of a row to be drawn 0, 1, 2, ... times.
_DRAWN = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def bootstrap_weights(ticket: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in the sample of a tree: Poisson with mean 1, from the row's hash."""
    salt = np.uint64((seed * 1_000_003 + tree) % 2 ** 63)
    u = (_mix(ticket.view(np.uint64) ^ _mix(np.array([salt]))[0]) >> np.uint64(11)) / float(1 << 53)
    weight = np.zeros(len(u), dtype=np.int8)
    for chance in _DRAWN:
        weight += u >= chance
    return weight.astype(np.int64)


def _tries(seed: int, tree: int, node: int, width: int) -> np.ndarray:
    """The order in which a node considers the features."""
    return np.random.default_rng([seed, tree, node]).permutation(width)


@dataclass
class _Tree:
    """The nodes of the upper part of a tree. Bins up to ``cut`` go to child ``left``, others to
    the next one. ``tried`` features have been considered; a node is open, small or a leaf. ``rows``
    of an open node are known once it or its parent was counted."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    tried: list[int] = field(default_factory=lambda: [0])
    state: list[str] = field(default_factory=lambda: ["open"])
    rows: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int) -> int:
        first = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.state[node] = feature, cut, first, "split"
        for column, value in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.tried, 0),
                              (self.state, "open"), (self.rows, 0)):
            column += [value, value]
        return first

    def open_nodes(self) -> list[int]:
        return [n for n, s in enumerate(self.state) if s == "open"]

    def open_rows(self) -> int:
        return sum(self.rows[n] for n in self.open_nodes())

    def route(self, bins: np.ndarray) -> np.ndarray:
        """The node of each row of bin numbers."""
        feature, cut, left = (np.array(x) for x in (self.feature, self.cut, self.left))
        ends = feature < 0
        # Where a row has arrived, it stays: its bin is at most the highest number.
        cut, left = np.where(ends, np.iinfo(np.int64).max, cut), np.where(ends, np.arange(len(ends)), left)
        by_feature = bins.flags.f_contiguous
        flat, step = (bins.T.ravel(), 1) if by_feature else (bins.ravel(), bins.shape[1])
        first = np.where(ends, 0, feature) * (len(bins) if by_feature else 1)
        node = np.zeros(len(bins), dtype=np.int64)
        going = np.arange(0 if ends[0] else len(bins))
        at = node[going]
        while len(going):
            place = going * step
            for _ in range(4):
                at = left.take(at) + (flat.take(place + first.take(at)) > cut.take(at))
            node[going] = at
            on = np.flatnonzero(~ends.take(at))
            going, at = going.take(on), at.take(on)
        return node


def _gini_sum(counts: np.ndarray) -> np.ndarray:
    """Rows times impurity, for class counts in the last axis."""
    n = counts.sum(axis=-1)
    return n - (counts.astype(float) ** 2).sum(axis=-1) / np.maximum(n, 1)


def _to_bins(x: np.ndarray, borders: list[np.ndarray]) -> np.ndarray:
    """Bin numbers (row, feature), which lie feature by feature."""
    return np.stack([np.searchsorted(b, x[:, j]) for j, b in enumerate(borders)]).astype(np.min_scalar_type(BINS)).T


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
    return (x, batch.column("y").to_numpy(zero_copy_only=False),
            batch.column("ticket").to_numpy(zero_copy_only=False))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The arrays of some batches at a time."""
    some, n = [], 0
    for batch in batches:
        if len(batch):
            some.append(_arrays(batch))
            n += len(batch)
        if n >= BLOCK_ROWS:
            yield tuple(np.concatenate(a) for a in zip(*some, strict=True))
            some, n = [], 0
    if some:
        yield tuple(np.concatenate(a) for a in zip(*some, strict=True))


def _borders(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Bin borders of every feature: quantiles of the rows with the lowest hashes."""
    low = rows.orderBy("ticket", "x").limit(BORDER_ROWS).select("x").toArrow()      # a bounded sample
    x = low.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    steps = np.linspace(0, 1, BINS + 1)[1:-1]
    return [np.unique(np.quantile(x[:, j], steps, method="lower")) for j in range(width)]


def _counted(rows: DataFrame, trees: dict[int, _Tree], wanted: dict[tuple[int, int], list[int]],
             borders: list[np.ndarray], classes: int, seed: int) -> dict[tuple[int, int, int], np.ndarray]:
    """Counts by bin and class of the wanted features of open nodes: {(tree, node, feature): ...}."""
    cells = [(t, n, f) for (t, n), fs in sorted(wanted.items()) for f in fs]
    place = {cell: i for i, cell in enumerate(cells)}
    size = (BINS + 1) * classes
    by_tree = _cells_by_tree(trees, wanted, place)
    used = {t: trees[t] for t in by_tree}
    shared = rows.sparkSession.sparkContext.broadcast((used, by_tree, borders))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, by_tree, borders = shared.value
        total = np.zeros(len(cells) * size, dtype=np.int64)
        for x, y, ticket in _blocks(batches):
            bins = _to_bins(x, borders)
            for t, (number, features, first) in by_tree.items():
                weight = bootstrap_weights(ticket, t, seed)
                here = np.flatnonzero(weight)
                at = number.take(trees[t].route(bins.T.take(here, axis=1).T))
                here, at = here.compress(at >= 0), at.compress(at >= 0)
                drawn = weight[here]
                slot = first[at] * size + y[here]
                start, end = int(first[0]) * size, (int(first[-1]) + int((features[-1] >= 0).sum())) * size
                for k in range(features.shape[1]):
                    f = features[at, k]
                    some = f >= 0                       # the last tries of a node may be fewer
                    own = bins[here[some], f[some]].astype(np.int64)
                    at_bin = slot[some] + k * size + own * classes - start
                    total[start:end] += np.bincount(at_bin, drawn[some], end - start).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["slot", "n"])

    table = np.zeros(len(cells) * size, dtype=np.int64)
    added = rows.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table[added.column("slot").to_numpy()] = added.column("n").to_numpy()      # COUNTS_AT_ONCE at most
    return {cell: table[i * size:(i + 1) * size].reshape(-1, classes) for cell, i in place.items()}


def _cells_by_tree(trees: dict[int, _Tree], wanted: dict[tuple[int, int], list[int]],
                   place: dict[tuple[int, int, int], int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per tree: the number of each node among the wanted ones or -1, the features of these (-1 where
    there is none), and the place of the first; the places of a tree follow one another."""
    out, most = {}, max(map(len, wanted.values()))
    for t in sorted({t for t, _ in wanted}):
        nodes = sorted(n for own, n in wanted if own == t)
        number = np.full(len(trees[t].state), -1, dtype=np.int64)
        number[nodes] = np.arange(len(nodes))
        features = np.array([wanted[t, n] + [-1] * (most - len(wanted[t, n])) for n in nodes], dtype=np.int64)
        out[t] = number, features, np.array([place[t, n, wanted[t, n][0]] for n in nodes], dtype=np.int64)
    return out


def _grow_large(rows: DataFrame, group: Sequence[int], borders: list[np.ndarray], classes: int, width: int,
                seed: int, small: int) -> tuple[dict[int, _Tree], list[tuple[int, int, float]]]:
    """The upper parts of some trees, until no open node is left, and their decreases."""
    trees, decreases = {t: _Tree() for t in group}, []
    at_a_time = max(1, math.isqrt(width))
    per_pass = max(1, COUNTS_AT_ONCE // (at_a_time * (BINS + 1) * classes))
    passing = list(trees)
    while passing:
        open_nodes = [(t, n) for t in passing for n in trees[t].open_nodes()]
        for start in range(0, len(open_nodes), per_pass):
            wanted = {(t, n): _next_tries(trees[t], seed, t, n, width) for t, n in open_nodes[start:start + per_pass]}
            counts = _counted(rows, trees, wanted, borders, classes, seed)
            for (t, n), features in wanted.items():
                _decide(trees[t], t, n, features, counts, width, small, decreases)
        passing = [t for t in passing if trees[t].open_rows() > _rows_of_width(BINNED_ROWS, width)]
    some, most = {}, _rows_of_width(BINNED_AT_ONCE, width)
    for t, tree in trees.items():
        if not tree.open_nodes():
            continue
        if some and sum(o.open_rows() for o in some.values()) + tree.open_rows() > most:
            _grow_binned(rows, some, trees, decreases, borders, classes, width, seed, small)
            some = {}
        some[t] = tree
    if some:
        _grow_binned(rows, some, trees, decreases, borders, classes, width, seed, small)
    return trees, decreases


def _grow_binned(rows: DataFrame, some: dict[int, _Tree], trees: dict[int, _Tree], decreases: list,
                 borders: list[np.ndarray], classes: int, width: int, seed: int, small: int) -> None:
    """Split the open nodes of some trees on until none is left, each tree in one task."""
    shared = rows.sparkSession.sparkContext.broadcast((some, borders))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, borders = shared.value
        for x, y, ticket in _blocks(batches):
            bins = _to_bins(x, borders)
            names, packed = [], []
            for t, tree in trees.items():
                is_open = np.array([s == "open" for s in tree.state])
                weight = bootstrap_weights(ticket, t, seed)
                here = np.flatnonzero(weight)
                own = bins.T.take(here, axis=1)
                kept = np.flatnonzero(is_open.take(tree.route(own.T)))
                here = here.take(kept)
                names.append(t)
                packed.append(_packed(own.take(kept, axis=1), _votes(y.take(here), weight.take(here), classes)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(packed, pa.binary())],
                                             names=["tree", "rows"])

    def grow(key: tuple, rows: pa.Table) -> pa.Table:
        t = int(key[0].as_py())
        tree, found = shared.value[0][t], []
        _split_binned(tree, t, _joined(rows), classes, width, seed, small, found)
        return pa.table({"tree": pa.array([t], pa.int32()), "grown": pa.array([pickle.dumps((tree, found))], pa.binary())})

    dealt = rows.mapInArrow(deal, "tree int, rows binary").repartition(min(PARTS, 2 * len(some)), "tree")
    grown = dealt.groupBy("tree").applyInArrow(grow, "tree int, grown binary").collect()   # one row per tree
    for r in sorted(grown, key=lambda r: r["tree"]):
        trees[r["tree"]], found = pickle.loads(r["grown"])
        decreases += found


def _split_binned(tree: _Tree, t: int, binned: list[np.ndarray], classes: int, width: int, seed: int, small: int,
                  decreases: list) -> None:
    """What the passes do to the open nodes of a tree, on the bins (feature, row) and votes of their rows."""
    bins, votes = binned
    most = int(votes.max()) // classes + 1 if len(votes) else 1
    at = np.concatenate([tree.route(np.ascontiguousarray(bins[:, i:i + BLOCK_ROWS]).T).astype(np.int32)
                         for i in range(0, len(votes), BLOCK_ROWS)] or [np.zeros(0, np.int32)])
    rows_of = {n: np.flatnonzero(at == n) for n in tree.open_nodes()}
    del at

    def counted(cell: np.ndarray, cells: int) -> np.ndarray:
        found = np.bincount(cell, minlength=cells * most * classes).reshape(cells, most, classes)
        return (found * np.arange(most)[:, None]).sum(axis=1)

    while rows_of:
        for n, here in sorted(rows_of.items()):
            own = votes.take(here).astype(np.int64)
            if _settled(tree, n, counted(own, 1)[0], small):
                del rows_of[n]
                continue
            features, first = _next_tries(tree, seed, t, n, width), len(tree.state)
            counts = {(t, n, f): counted(bins[f].take(here).astype(np.int64) * (most * classes) + own, BINS + 1)
                      for f in features}
            _decide(tree, t, n, features, counts, width, small, decreases)
            if tree.state[n] != "open":
                del rows_of[n]
            if tree.state[n] == "split":
                right = bins[tree.feature[n]].take(here) > tree.cut[n]
                rows_of[first], rows_of[first + 1] = here.compress(~right), here.compress(right)


def _rows_of_width(rows: int, width: int) -> int:
    return rows * 8 // max(8, width)


def _next_tries(tree: _Tree, seed: int, t: int, n: int, width: int) -> list[int]:
    done = tree.tried[n]
    return _tries(seed, t, n, width)[done:done + max(1, math.isqrt(width))].tolist()


def _settled(tree: _Tree, n: int, whole: np.ndarray, small: int) -> bool:
    """Whether an open node turns out small or pure."""
    if whole.sum() > small and (whole > 0).sum() > 1:
        return False
    tree.state[n] = "leaf" if (whole > 0).sum() < 2 else "small"
    return True


def _decide(tree: _Tree, t: int, n: int, features: list[int], counts: dict, width: int, small: int,
            decreases: list) -> None:
    """Split an open node at its best border, or find it small, pure or without any border."""
    whole = counts[t, n, features[0]].sum(axis=0)
    if _settled(tree, n, whole, small):
        return
    best, low = (0.0, -1, 0), 0
    for f in features:
        below = counts[t, n, f].cumsum(axis=0)[:-1]
        inside = (below.sum(axis=1) > 0) & (below.sum(axis=1) < whole.sum())
        gain = np.where(inside, _gini_sum(whole) - _gini_sum(below) - _gini_sum(whole - below), -1.0)
        at = int(gain.argmax())
        if inside.any() and (best[1] < 0 or gain[at] > best[0]):
            best, low = (float(gain[at]), f, at), int(below[at].sum())
    tree.tried[n] += len(features)
    tree.rows[n] = int(whole.sum())
    if best[1] >= 0:
        first = tree.split(n, best[1], best[2])
        tree.rows[first:] = [low, tree.rows[n] - low]
        decreases.append((t, best[1], best[0]))
    elif tree.tried[n] >= width:
        tree.state[n] = "leaf"


def _ranks(x: np.ndarray) -> list[np.ndarray]:
    """Per feature the rank of each row's value among the distinct ones."""
    return [np.unique(column, return_inverse=True)[1] for column in x.T]


def _votes(y: np.ndarray, weight: np.ndarray, classes: int) -> np.ndarray:
    """Class and weight of each row as one number."""
    return (weight * classes + y).astype(np.min_scalar_type((len(_DRAWN) + 1) * classes))


def _sum_of(counts: list[np.ndarray]) -> np.ndarray:
    """Rows times impurity, for the counts of each class."""
    n, squares = sum(counts[1:], counts[0]), sum((c * c for c in counts[1:]), counts[0] * counts[0])
    return n - squares / np.maximum(n, 1)


def _best_cuts(packed: np.ndarray, bits: int, ranks: int, weights: np.ndarray,
               whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gain, cut) of each node's best cut of its rows' ranks; gain -inf where all are equal.

    Rows of all nodes are sorted at once, as whole numbers of node, rank and votes; ranks up to
    the cut go left. ``weights`` gives the rows of every two classes that votes stand for. Only the
    last row of equal values is counted. The first of equally good cuts counts.
    """
    best, cut = np.full(len(whole), -np.inf), np.zeros(len(whole), dtype=np.int64)
    packed.sort()
    votes = packed & ((1 << bits) - 1)
    packed >>= bits                                     # node and rank
    ends = np.flatnonzero(packed[1:] != packed[:-1])
    place = packed.take(ends)
    node = place >> ranks
    inner = node == packed.take(ends + 1) >> ranks      # not the last value of a node
    if not inner.any():
        return best, cut
    # Nodes lie behind one another, so what the nodes before hold is taken off.
    present = np.zeros(len(whole), dtype=bool)
    present[node] = present[packed[-1] >> ranks] = True
    held = np.where(present[:, None], whole, 0.0)
    before = held.cumsum(axis=0) - held
    at, ends, place = node[inner], ends[inner], place[inner]
    below, above = [], []
    for k in range(0, whole.shape[1], 2):               # two classes in the halves of a number
        upto = np.cumsum(weights[k // 2].take(votes)).take(ends)
        for j, n in ((k, upto & _HALF), (k + 1, upto >> 32))[:whole.shape[1] - k]:
            below.append(n - before[:, j].take(at))
            above.append(whole[:, j].take(at) - below[-1])
    gain = _gini_sum(whole).take(at) - _sum_of(below) - _sum_of(above)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    best[at[first]] = np.maximum.reduceat(gain, first)
    hits = np.flatnonzero(gain == best.take(at))
    owner, one = np.unique(at[hits], return_index=True)
    cut[owner] = place[hits[one]] & ((1 << ranks) - 1)
    return best, cut


def _subtree(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int,
             rng: np.random.Generator) -> np.ndarray:
    """Grow a subtree to purity, all nodes of a level at once; the summed decreases of each feature.

    A node considers features in an order of its own until enough of them can split it: one that
    is constant in the node doesn't count. The order of the rows doesn't matter.
    """
    out, width, n = np.zeros(x.shape[1]), x.shape[1], len(y)
    enough = max(1, math.isqrt(width))
    if not n:
        return out
    votes = np.asarray(weight, dtype=np.int64) * classes + y
    bits, kinds = int(votes.max()).bit_length(), int(votes.max()) + 1
    weights = np.zeros((classes, kinds))
    weights[np.arange(kinds) % classes, np.arange(kinds)] = np.arange(kinds) // classes
    halves = np.vstack([weights, np.zeros((classes % 2, kinds))]).astype(np.int64)
    pairs = halves[::2] | halves[1::2] << 32
    ranked = np.stack(_ranks(x))
    ranks = int(ranked.max()).bit_length()
    # Rank and votes of every feature in one row of numbers: (feature, row) lies at feature * n + row.
    keys = ((ranked << bits) | votes).ravel()
    rows, node = np.arange(n), np.zeros(n, dtype=np.int64)
    while len(rows):
        n_nodes = int(node.max()) + 1
        whole = np.bincount(node * kinds + votes.take(rows), minlength=n_nodes * kinds).reshape(n_nodes, kinds) @ weights.T
        mixed = (whole > 0).sum(axis=1) > 1
        if not mixed.all():
            on = np.flatnonzero(mixed.take(node))
            rows, node = rows.take(on), (np.cumsum(mixed) - 1).take(node.take(on))
            whole = whole[mixed]
        if not len(rows):
            break
        tries = rng.random((len(whole), width)).argsort(axis=1)
        best, feature, cut = np.full(len(whole), -np.inf), *np.zeros((2, len(whole)), dtype=np.int64)
        seen = np.zeros(len(whole), dtype=np.int64)
        above = node << (ranks + bits)
        for k in range(width):
            going = seen < enough
            if not going.any():
                break
            own = tries[:, k]
            if going.all():
                packed = keys.take((own * n).take(node) + rows) | above
            else:
                here = np.flatnonzero(going.take(node))
                packed = keys.take((own * n).take(node.take(here)) + rows.take(here)) | above.take(here)
            gain, at = _best_cuts(packed, bits, ranks, pairs, whole)
            better = going & (gain > best)
            best[better], feature[better], cut[better] = gain[better], own[better], at[better]
            seen += going & (gain > -np.inf)
        split = best > -np.inf
        np.add.at(out, feature[split], best[split])
        if not split.all():
            on = np.flatnonzero(split.take(node))
            rows, node = rows.take(on), node.take(on)
        right = keys.take((feature * n).take(node) + rows) >= ((cut + 1) << bits).take(node)
        node = 2 * node + right
        used = np.zeros(2 * len(whole), dtype=bool)
        used[node] = True
        node = (np.cumsum(used) - 1).take(node)
    return out


def _packed(*arrays: np.ndarray) -> bytes:
    """Some rows of a node as one value: millions of rows cross as thousands."""
    return pickle.dumps(tuple(np.ascontiguousarray(a) for a in arrays), pickle.HIGHEST_PROTOCOL)


def _unpacked(rows: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(rows)


def _joined(rows: pa.Table) -> list[np.ndarray]:
    """The packed rows of a group, as arrays whose last axis is the row."""
    parts = zip(*(_unpacked(r.as_py()) for r in rows.column("rows")), strict=True)
    return [np.concatenate(a, axis=-1) for a in parts]


def _finish(classes: int, seed: int) -> Callable:
    """Grouped-map function that finishes one small node."""
    def grow(tree: int, node: int, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> pd.DataFrame:
        found = _subtree(x, y, weight, classes, np.random.default_rng([seed, tree, node, 1]))
        used = np.flatnonzero(found)
        return pd.DataFrame({"tree": np.int32(tree), "feature": used.astype(np.int32), "decrease": found[used]})

    def finish(key: tuple, rows: pa.Table) -> pa.Table:
        x, votes = _joined(rows)
        weight, y = np.divmod(votes.astype(np.int64), classes)
        frame = grow(int(key[0].as_py()), int(key[1].as_py()), x.T, y, weight)
        return pa.Table.from_pandas(frame, preserve_index=False)

    return finish


def _grow_small(rows: DataFrame, trees: dict[int, _Tree], borders: list[np.ndarray], classes: int,
                seed: int) -> DataFrame:
    """(tree, feature, decrease) of all small nodes, each finished in one task."""
    shared = rows.sparkSession.sparkContext.broadcast((trees, borders))

    def batch(chunks: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        trees, nodes, packed = zip(*chunks, strict=True) if chunks else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(trees, pa.int32()), pa.array(nodes, pa.int64()), pa.array(packed, pa.binary())],
            names=["tree", "node", "rows"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, borders = shared.value
        small = {t: np.array([s == "small" for s in tree.state]) for t, tree in trees.items()}
        for x, y, ticket in _blocks(batches):
            bins, by_feature = _to_bins(x, borders), np.ascontiguousarray(x.T)
            chunks: list[tuple[int, int, bytes]] = []
            held = 0
            for t, tree in trees.items():
                weight = bootstrap_weights(ticket, t, seed)
                here = np.flatnonzero(weight)
                at = tree.route(bins.T.take(here, axis=1).T)
                kept = np.flatnonzero(small[t].take(at))
                at = at.take(kept).astype(np.min_scalar_type(len(tree.state)))
                order = at.argsort(kind="stable")
                here, at = here.take(kept.take(order)), at.take(order)
                own, votes = by_feature.take(here, axis=1), _votes(y.take(here), weight.take(here), classes)
                ends = np.r_[np.flatnonzero(np.diff(at)) + 1, len(at)].tolist()
                for i, j in zip([0, *ends[:-1]], ends, strict=True):
                    if j > i:
                        chunks.append((t, int(at[i]), _packed(own[:, i:j], votes[i:j])))
                held += own.nbytes
                if held > BYTES_AT_ONCE:
                    yield batch(chunks)
                    chunks, held = [], 0
            yield batch(chunks)

    groups = sum(s == "small" for tree in trees.values() for s in tree.state)
    dealt = rows.mapInArrow(deal, "tree int, node long, rows binary").repartition(
        max(1, min(PARTS, 2 * groups)), "tree", "node")
    return dealt.groupBy("tree", "node").applyInArrow(_finish(classes, seed), _DECREASE)


def impurity_decreases(df: DataFrame, cols: Sequence[str], label: str, trees: int, seed: int,
                       key: Sequence[str] = (), small: int = SMALL_ROWS) -> np.ndarray:
    """(tree, feature) summed decreases of impurity of a forest that separates ``label``.

    ``df`` is read several times: pass a staged table. ``key`` names columns that identify a row;
    without one, equal rows share their draws. Rows with a null among label and ``cols`` are left
    out. A large node that no bin border splits stays a leaf.
    """
    cols = list(cols)
    kept = df.na.drop(subset=[label, *cols])
    values = [r[0] for r in kept.select(label).distinct().limit(MAX_CLASSES + 1).collect()]
    if len(values) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} values")
    out = np.zeros((trees, len(cols)))
    if len(values) < 2:
        return out
    number = F.array_position(F.array(*[F.lit(v) for v in sorted(values)]), F.col(label)) - 1
    x = F.array(*[F.col(c).cast("double") for c in cols])
    ticket = F.xxhash64(F.lit(seed), *(key or [label, *cols]))
    rows = kept.select(ticket.alias("ticket"), number.cast("int").alias("y"), x.alias("x"))
    total = rows.count()
    group = max(1, min(trees, _rows_of_width(ROWS_AT_ONCE, len(cols)) // total))
    borders = _borders(rows, len(cols))
    # The upper parts of all trees share their passes; only the rows of the lower parts are many.
    grown, decreases = _grow_large(rows, range(trees), borders, len(values), len(cols), seed, small)
    for t, f, gain in decreases:
        out[t, f] += gain
    for first in range(0, trees, group):
        some = {t: grown[t] for t in range(first, min(first + group, trees))}
        below = _grow_small(rows, some, borders, len(values), seed)
        # Decimals: their sum is the same in any order. At most one row per tree and feature.
        sums = below.groupBy("tree", "feature").agg(F.sum(F.col("decrease").cast("decimal(28,9)")).alias("d"))
        for r in sums.collect():
            out[r["tree"], r["feature"]] += float(r["d"])
    return out
