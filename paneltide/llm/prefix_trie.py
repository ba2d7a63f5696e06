"""The trie of conversation prefixes, as balanced parentheses per shard.

A conversation is a path of turns. Each prefix of it has a 128-bit key, so paths are arrays of
keys; equal conversations are counted before anything else is done with them. Different paths are
range-partitioned in the order of their keys, so each shard holds a run of the trie in depth-first
order and writes it as a sequence of parentheses. The place of a node's opening parenthesis follows
from its number and depth; ``find_close`` finds the closing one through a tree of the least excess
of blocks. Between the two lies the node's subtree: the rank of "()" pairs counts its leaves, and
differences of cumulative arrays give its conversations and savings.

Only nodes on the first and on the last path of a shard may lie in other shards as well. These
spines are merged: what hangs off them inside a shard is added up, and what they hold themselves is
summed from below along one path that owns it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneltide.sources.io import stage_via_parquet

SIBLINGS = 5              # conversations that share a head
HEAD_TURNS = 9            # a shared head has fewer turns than this
#: Turns of different paths in one shard: it bounds what one task holds.
SHARD_TURNS = 400_000
#: Spines are broadcast up to this many nodes, else joined by a salted shuffle.
BROADCAST_SPINES = 100_000
SALTS = 16
BLOCK = 64                # parentheses whose least excess is one leaf of the tree
NONE_SHA = hashlib.sha256(b"").hexdigest()

_KEY = ["depth", "k1", "k2"]


def head_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string")) % HEAD_TURNS).cast("int")


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, bytes): every rebuilt turn with the key of the prefix it ends.

    ``turns`` has conv_id, turn, role, text. Turns are ordered by turn, null first, equal ones by
    the MD5 of role and text. Rows go through the sort as hashes, not as texts.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    token = F.md5(F.concat_ws("\x00", role, text)).alias("token")
    own = (turns.where("conv_id is not null")
           .select("conv_id", "turn", token, F.octet_length(text).cast("long").alias("bytes"))
           .withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(
               F.asc_nulls_first("turn"), "token")) - 1))
    own = stage_via_parquet(own.select("conv_id", "k", "token", "bytes"))
    tail = own.where(F.col("k") >= head_turns(F.col("conv_id"))).withColumn("part", F.lit(1))
    heads = (own.where(F.col("conv_id") % SIBLINGS == 0).where(F.col("k") < HEAD_TURNS - 1)
             .withColumn("conv_id", F.explode(_siblings(F.col("conv_id"))))
             .where(F.col("k") < head_turns(F.col("conv_id"))).withColumn("part", F.lit(0)))
    heads = heads.join(own.select("conv_id").distinct(), "conv_id", "left_semi")
    order = Window.partitionBy("conv_id").orderBy("part", "k")
    placed = tail.unionByName(heads).withColumn("depth", F.row_number().over(order).cast("long"))
    to_here = order.rowsBetween(Window.unboundedPreceding, 0)
    return placed.select(
        "conv_id", "depth", F.bit_xor(F.xxhash64("depth", "token")).over(to_here).alias("k1"),
        F.bit_xor(F.xxhash64("token", "depth", F.lit("second"))).over(to_here).alias("k2"), "bytes")


def _siblings(base: Column) -> Column:
    """Ids c with c - c % SIBLINGS = base; % keeps the sign, so 0 has some on either side."""
    up = F.when(base >= 0, SIBLINGS - 1).otherwise(0)
    down = F.when(base <= 0, SIBLINGS - 1).otherwise(0)
    return F.sequence(base - down, base + up)


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key and conv_id to (key, n, least, sha); only a running hash is held."""
    open_key, digest, n, least = None, None, 0, 0
    out: list[tuple] = []
    for batch in batches:
        keys = list(zip(*(batch[c].tolist() for c in _KEY), strict=True))
        ids = batch["conv_id"].tolist()
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if keys[a] != open_key:
                if open_key is not None:
                    out.append((*open_key, n, least, digest.hexdigest()))
                open_key, digest, n, least = keys[a], hashlib.sha256(), 0, ids[a]
            digest.update(("," * (n > 0) + ",".join(map(str, ids[a:b]))).encode())
            n += b - a
        if out:
            yield pd.DataFrame(out, columns=[*_KEY, "n", "least", "sha"])
            out = []
    if open_key is not None:
        yield pd.DataFrame([(*open_key, n, least, digest.hexdigest())],
                           columns=[*_KEY, "n", "least", "sha"])


def distinct_paths(turns: DataFrame) -> DataFrame:
    """(least, n, sha, k1s, k2s, bytes): one row per different rebuilt conversation."""
    rows = stage_via_parquet(rebuilt_turns(turns))
    last = rows.groupBy("conv_id").agg(F.max(F.struct(*_KEY)).alias("end"))
    convs = turns.where("conv_id is not null").select("conv_id").distinct()
    none = F.lit(0).cast("long")
    ends = convs.join(last, "conv_id", "left").select(
        "conv_id", *[F.coalesce(F.col(f"end.{c}"), none).alias(c) for c in _KEY])
    groups = stage_via_parquet(
        ends.repartition(*_KEY).sortWithinPartitions(*_KEY, "conv_id")
        .mapInPandas(_ends, "depth long, k1 long, k2 long, n long, least long, sha string"))
    chosen = groups.select(F.col("least").alias("conv_id"), "least", "n", "sha")
    path = F.array_sort(F.collect_list(F.struct(*_KEY, "bytes")))
    arrays = rows.join(chosen.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(path.alias("path"))
    part = lambda c: F.coalesce(F.col(f"path.{c}"), F.array().cast("array<long>"))
    return chosen.join(arrays, "conv_id", "left").select(
        "least", "n", "sha", part("k1").alias("k1s"), part("k2").alias("k2s"), part("bytes").alias("bytes"))


def find_close(bits: np.ndarray) -> np.ndarray:
    """The place of the closing parenthesis of every opening one (bits 1), in order.

    The first place after an opening one whose excess is lower. It is sought in the rest of the
    block, else the first block with so low an excess is found through a tree of block minima.
    """
    excess = np.cumsum(np.where(bits, 1, -1)).astype(np.int64)
    opens = np.flatnonzero(bits)
    target = excess[opens] - 1
    n_blocks = -(-len(bits) // BLOCK)
    padded = np.full(n_blocks * BLOCK, np.iinfo(np.int64).max)
    padded[:len(bits)] = excess
    tree = [padded.reshape(n_blocks, BLOCK).min(axis=1)]
    while len(tree[-1]) > 1:
        level = tree[-1]
        if len(level) % 2:
            level = tree[-1] = np.append(level, np.iinfo(np.int64).max)
        tree.append(level.reshape(-1, 2).min(axis=1))
    close = np.full(len(opens), -1)

    def scan(which: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Look for each target from ``at`` to the end of its block; return those not found."""
        missed = []
        while len(which):
            found = padded[at] <= target[which]
            close[which[found]] = at[found]
            which, at = which[~found], at[~found] + 1
            beyond = at % BLOCK == 0
            missed.append(which[beyond])
            which, at = which[~beyond], at[~beyond]
        return np.concatenate(missed) if missed else which

    every = np.arange(len(opens))
    ends = (opens + 1) % BLOCK == 0
    rest = np.concatenate([scan(every[~ends], opens[~ends] + 1), every[ends]])
    at, level = opens[rest] // BLOCK + 1, np.full(len(rest), -1)
    for k, minima in enumerate(tree):               # up: a right node is looked at alone
        going = level < 0
        alone = going & ((at % 2 == 1) | (len(minima) == 1))
        hit = np.zeros(len(rest), dtype=bool)
        hit[alone] = minima[at[alone]] <= target[rest[alone]]
        level[hit] = k
        going &= ~hit
        at[going] = (at[going] + 1) // 2
    for k in range(len(tree) - 1, 0, -1):           # down: to the left where that is low enough
        here = level == k
        left = 2 * at[here]
        at[here] = np.where(tree[k - 1][left] <= target[rest[here]], left, left + 1)
        level[here] = k - 1
    scan(rest, at * BLOCK)
    return close


def _least_in(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The least of values[t:t + size[t]] for every t, from minima over powers of two."""
    at = np.arange(len(values))
    power = np.frexp(size.astype(float))[1] - 1
    out, table = np.empty_like(values), values.copy()
    for k in range(int(power.max()) + 1):
        here = at[power == k]
        out[here] = np.minimum(table[here], table[here + size[here] - (1 << k)])
        shifted = np.full_like(table, np.iinfo(np.int64).max)
        shifted[:max(0, len(table) - (1 << k))] = table[1 << k:]
        table = np.minimum(table, shifted)
    return out


_OUT = {"spine": "boolean", "path": "long", "depth": "long", "k1": "long", "k2": "long", "p1": "long",
        "p2": "long", "bytes": "long", "n_convs": "long", "least": "long", "n_children": "long",
        "n_leaves": "long", "saved": "long", "sha": "string", "parent": "long"}


def shard_nodes(n: np.ndarray, least: np.ndarray, sha: list[str], starts: np.ndarray,
                keys: np.ndarray, lengths: np.ndarray, shard: int) -> pd.DataFrame:
    """The nodes of a shard's sorted paths. ``keys`` has rows (k1, k2, bytes) of all paths one
    after the other, from ``starts`` on."""
    ends = starts + lengths
    # Keys are of whole prefixes: paths agree as far as their keys are equal place by place.
    place = np.arange(keys.shape[1]) - np.repeat(starts, lengths)
    owner = np.repeat(np.arange(len(n)), lengths)
    before = np.where(owner > 0, starts[owner - 1] + place, 0)
    same = (owner > 0) & (place < lengths[owner - 1])
    same[same] = (keys[:2, same] == keys[:2, before[same]]).all(axis=0)
    shared = np.bincount(owner[same], minlength=len(n))

    new = np.flatnonzero(place >= shared[owner])
    depth = np.concatenate([[0], place[new] + 1])
    k1, k2, size_bytes = (np.concatenate([[0], keys[i, new]]) for i in range(3))
    up = new[place[new] > 0] - 1
    p1, p2 = np.zeros(len(depth), np.int64), np.zeros(len(depth), np.int64)
    deep = np.flatnonzero(depth > 1)
    p1[deep], p2[deep] = keys[0, up], keys[1, up]

    # Number of the last new node of each path, and of each node's parent.
    ended = np.cumsum(lengths - shared)
    parent = np.arange(len(depth)) - 1
    on_path = np.zeros(int(lengths.max(initial=0)) + 1, dtype=np.int64)
    for s, length, end in zip(shared.tolist(), lengths.tolist(), ended.tolist(), strict=True):
        if length:
            first = end - (length - s) + 1
            parent[first] = on_path[s]
            on_path[s + 1:length + 1] = np.arange(first, end + 1)
    last_path = on_path[:int(lengths[-1]) + 1].copy()
    first_path = np.arange(int(lengths[0]) + 1)

    bits = np.zeros(2 * len(depth), dtype=np.uint8)
    opens = 2 * np.arange(len(depth)) - depth
    bits[opens] = 1
    close = find_close(bits)
    size = (close - opens + 1) // 2
    pairs = np.concatenate([[0], np.cumsum((bits == 1) & (np.append(bits[1:], 1) == 0))])
    leaves = pairs[close + 1] - pairs[opens]

    held = np.zeros(len(depth), dtype=np.int64)
    low = np.full(len(depth), np.iinfo(np.int64).max)
    held[ended], low[ended] = n, least
    names = np.full(len(depth), None, dtype=object)
    names[ended] = sha

    def within(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        at = np.arange(len(depth))
        return total[at + size] - total[at]

    n_convs, low = within(held), _least_in(low, size)
    spine = np.zeros(len(depth), dtype=bool)
    spine[first_path], spine[last_path] = True, True
    saved = within(np.where(spine, 0, (n_convs - 1) * size_bytes))
    children = np.bincount(parent[1:][~spine[1:]], minlength=len(depth))
    leaves = leaves - within(spine & (size == 1))
    frame = pd.DataFrame({
        "spine": spine, "path": np.int64(2 * shard), "depth": depth, "k1": k1, "k2": k2, "p1": p1, "p2": p2,
        "bytes": size_bytes, "n_convs": n_convs, "least": low, "n_children": children, "n_leaves": leaves,
        "saved": saved, "sha": names, "parent": pd.array(low[parent], dtype="Int64")})
    frame.loc[(depth == 0) | spine[parent], "parent"] = pd.NA
    # The last path is a second row of its nodes; what both paths hold counts on the first only.
    again = frame.iloc[last_path].copy()
    again["path"] = np.int64(2 * shard + 1)
    on_both = np.isin(last_path, first_path)
    again.loc[on_both, ["n_convs", "n_children", "n_leaves", "saved"]] = 0
    alone = np.ones(len(depth), dtype=bool)
    alone[last_path[~on_both]] = False
    return pd.concat([frame[alone], again], ignore_index=True)[list(_OUT)]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if len(b)]
    if not held:
        return
    table = pa.Table.from_batches(held)
    lists = [table.column(c).combine_chunks() for c in ("k1s", "k2s", "bytes")]
    lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
    lengths = np.diff(lists[0].offsets.to_numpy())
    keys = np.stack([x.flatten().to_numpy(zero_copy_only=False) for x in lists]).astype(np.int64)
    frame = shard_nodes(table.column("n").to_numpy(), table.column("least").to_numpy(),
                        table.column("sha").to_pylist(), np.cumsum(lengths) - lengths, keys, lengths,
                        TaskContext.get().partitionId())
    yield from pa.Table.from_pandas(frame, preserve_index=False).to_batches(max_chunksize=10_000)


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join with the spines; the root may be the parent of any share of the rows."""
    if right.count() <= BROADCAST_SPINES:
        return left.join(F.broadcast(right), on, "left")
    salted = left.withColumn("_salt", F.pmod(F.xxhash64("k1", "k2"), F.lit(SALTS)).cast("int"))
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, [*on, "_salt"], "left").drop("_salt")


def _merged(spines: DataFrame) -> DataFrame:
    """One row per spine node, with its whole counts."""
    nodes = stage_via_parquet(spines.groupBy(*_KEY).agg(
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.min("least").alias("least"),
        F.min("path").alias("owner"), *[F.max(c).alias(c) for c in ("p1", "p2", "bytes", "sha")]))
    kids = (nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"),
                                             F.col("p2").alias("k2")).agg(F.count("*").alias("kids")))
    nodes = nodes.join(kids, _KEY, "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).drop("kids")
    own = nodes.select(*_KEY, "owner", (F.col("n_children") == 0).cast("long").alias("leaf"),
                       ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"))
    mine = (F.col("path") == F.col("owner")).cast("long")
    below = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = (spines.select("path", *_KEY).join(own, _KEY)
            .select(*_KEY, F.sum(F.col("leaf") * mine).over(below).alias("leaf"),
                    F.sum(F.col("own") * mine).over(below).alias("own"))
            .groupBy(*_KEY).agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own")))
    return stage_via_parquet(nodes.join(sums, _KEY).select(
        *_KEY, "p1", "p2", "least", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved") + F.col("own")).alias("saved"), "sha"))


def prefix_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    One row per different prefix of the rebuilt conversations (columns conv_id, turn, role, text).
    Rows without a conv_id take no part; null roles and texts are empty; repeated rows are turns of
    their own. A conversation without turns after rebuilding is a member of the root. An empty
    table has no rows, not even a root. One conversation's turns are one row while paths are built,
    so a task must hold the longest conversation (24 bytes a turn); equal ones are held once.
    """
    paths = stage_via_parquet(distinct_paths(turns))
    total = paths.agg(F.sum(F.size("k1s") + 1)).first()[0] or 0
    order = F.col("k1s")
    nodes = stage_via_parquet(
        paths.repartitionByRange(max(1, -(-total // shard_turns)), order).sortWithinPartitions(order)
        .mapInArrow(_shards, ", ".join(f"{c} {t}" for c, t in _OUT.items())))
    spines = _merged(nodes.where("spine"))
    parents = spines.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"),
                            F.col("k2").alias("p2"), F.col("least").alias("above"))
    columns = [*_KEY, "p1", "p2", "least", "n_convs", "n_children", "n_leaves", "saved", "sha"]
    rows = nodes.where("not spine").select(*columns, "parent").unionByName(
        spines.select(*columns, F.lit(None).cast("long").alias("parent")))
    rows = _joined(rows, parents, ["depth", "p1", "p2"])
    return rows.select(
        F.col("least").alias("conv_id"), "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", "above")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(NONE_SHA)).alias("ends_sha256"))
