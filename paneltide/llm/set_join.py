"""Exact Jaccard join of shingle sets by skipping with set relations.

Equal sets are one node. The shingles of a set are ordered, the rarer first, and the first few are
its prefix: two sets that link share a shingle of their prefixes. Index lists hold, per shingle,
the sets with it in their prefix, its position there and their size; what follows a shared shingle
in both orders bounds the intersection.

Answers follow from answers. Each long list is first compared with one leading set alone. Sets that
the leader's answers put into one component need no comparison with each other. Of the others the
difference from the leader is kept: two sets that differ from it in X and Y differ from each other
in just the symmetric difference of X and Y, so their intersection comes from two short lists.

What is left is compared in blocks of a list, cut by position and by whether sets belong to the
leader's component. A pair of blocks is skipped as a whole if its positions and sizes allow no link
or both belong to the leader. Within blocks, pairs are tested on positions, sizes and a parity
bitmap (each shingle that only one of the sets has flips one bit, so the number of unequal bits is
a lower bound of the difference). Only pairs that pass become rows; they
are tested on longer bitmaps and then on differences or whole sets. No step is approximate: every
link between different components is found.

The order must be the same for all sets, but any order is right. Shingles in ``1 / COMMON`` of all
shingle occurrences or more come last, by their count; there are at most ``COMMON`` of them,
whatever the number of documents. The others are in the order of their hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneltide.llm.components import connected_components, extended_components
from paneltide.llm.shingles import (SET, Compare, alpha, as_links, bitmap, folded, join_hot,
                                    links, set_keys, texts_and_sets, tied_texts, unequal_bits)
from paneltide.sources.io import stage_via_parquet

LINK_PERCENT = 90
#: At most so many common shingles are told apart by their counts (12 MB in each Python worker).
COMMON = 2 ** 20
LEAST_COMMON = 8
#: Shingle occurrences counted in one task.
COUNTED_AT_ONCE = 4_000_000
#: Occurrences in one row on the way there.
SLOTS_AT_ONCE = 500_000
#: Lists longer than this are first compared with a leader.
LEADER_FROM = 16
#: Entries of one block of an index list.
BLOCK = 512
#: Entries of lists carry the bitmap folded by this, to so many words at most: half a bit per
#: shingle tells strangers apart, and longer sets are told apart by the pairs' whole bitmaps.
BRIEF_FOLD = 8
BRIEF_WORDS = 32
#: Pairs of entries, and words of their bitmaps, compared at once.
PAIRS_AT_ONCE = 1_000_000
WORDS_AT_ONCE = 1_000_000


# Sets, in Python workers.

def _packed(slots: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as differences, byte planes apart: high planes are nearly all zero."""
    steps = np.diff(slots, prepend=np.uint32(0)).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(32)).astype(np.uint32)


def _sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of documents, and among them rows that hold the slots of many shingles."""
    held, n_held = [], 0

    def flush() -> pd.DataFrame:
        return pd.DataFrame({"doc_id": [None], "n_shingles": [None], "key_a": [None], "key_b": [None],
                             "slots": [_packed(np.sort(np.concatenate(held)))]})

    for part, sets in texts_and_sets(batches):
        keys = [set_keys(s) for s in sets]
        yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_shingles": [len(s) for s in sets],
                            "key_a": [k[0] for k in keys], "key_b": [k[1] for k in keys], "slots": None})
        held.append(_slots(np.concatenate(sets)))
        n_held += len(held[-1])
        if n_held >= SLOTS_AT_ONCE:
            yield flush()
            held, n_held = [], 0
    if n_held:
        yield flush()


def prefixes(sets: list[np.ndarray], slots: np.ndarray, counts: np.ndarray,
             percent: int) -> list[np.ndarray]:
    """The prefix of each non-empty set. ``slots`` (sorted) are common, ``counts`` times each."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    own = _slots(flat)
    count = np.zeros(len(flat), dtype=np.int64)
    if len(slots):
        at = np.minimum(np.searchsorted(slots, own), len(slots) - 1)
        count = np.where(slots[at] == own, counts[at], 0)
    if count.any():
        flat = flat[np.lexsort((flat, count, owner))]
    take = sizes - -(-percent * sizes // 100) + 1
    starts = np.cumsum(sizes) - sizes
    return [flat[a:a + n].view(np.int64) for a, n in zip(starts.tolist(), take.tolist(), strict=True)]


# Counts and the index.

def _common_shingles(sized: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the common shingles, sorted, and their counts over all documents."""
    total = sized.agg(F.sum("n_shingles")).first()[0] or 0
    least = max(LEAST_COMMON, -(-total // COMMON))
    bits = max(3, (total // COUNTED_AT_ONCE).bit_length())

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["slots"]:
                slots = _unpacked(data)
                cuts = np.searchsorted(slots >> np.uint32(32 - bits), np.arange((1 << bits) + 1))
                rows = [(b, _packed(slots[a:z])) for b, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)) if z > a]
                yield pd.DataFrame(rows, columns=["bucket", "slots"])

    def count(bucket: pd.DataFrame) -> pd.DataFrame:
        slots = np.sort(np.concatenate([_unpacked(x) for x in bucket["slots"]]))
        starts = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
        n = np.diff(np.r_[starts, len(slots)])
        return pd.DataFrame({"slot": slots[starts][n >= least].astype(np.int64), "n": n[n >= least]})

    found = (sized.where("slots is not null").select("slots").mapInPandas(split, "bucket int, slots binary")
             .groupBy("bucket").applyInPandas(count, "slot long, n long").orderBy("slot").toArrow())
    return (found.column("slot").to_numpy().astype(np.uint32), found.column("n").to_numpy())


def _index(docs: DataFrame, sized: DataFrame, percent: int) -> DataFrame:
    """(node, n, tokens, bits, brief): each different set, with its prefix, its parity bitmap and a
    fold of that. A doc_id on rows of several texts is a node of several sets."""
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(_common_shingles(sized))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, sets in texts_and_sets(batches):
            some = [i for i, s in enumerate(sets) if len(s)]
            if some:
                sets = [sets[i] for i in some]
                keys = [set_keys(s) for s in sets]
                bits = [(x, folded(x, max(1, min(len(x) // BRIEF_FOLD, BRIEF_WORDS)))) for x in map(bitmap, sets)]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy()[some], "n_shingles": [len(s) for s in sets],
                    "key_a": [k[0] for k in keys], "key_b": [k[1] for k in keys],
                    "tokens": prefixes(sets, *common.value, percent), "bits": [x for x, _ in bits],
                    "brief": [x for _, x in bits]})

    rows = docs.where("doc_id is not null").select("doc_id", "text").mapInPandas(
        index, "doc_id long, n_shingles long, key_a long, key_b long, tokens array<long>, bits array<long>, "
               "brief array<long>")
    return stage_via_parquet(rows.groupBy(*SET).agg(
        F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("tokens", "bits", "brief")])
        .withColumnRenamed("n_shingles", "n"))


def _may_link(percent: int, n_x: Column, at_x: Column, n_y: Column, at_y: Column) -> Column:
    least = F.ceil(percent * (n_x + n_y) / F.lit(100 + percent))
    return ((F.least(n_x, n_y) * 100 >= F.greatest(n_x, n_y) * percent)
            & (F.least(n_x - at_x, n_y - at_y) >= least))


# Comparison by blocks and by differences.

class _Entries(NamedTuple):
    """Entries of index lists, one after the other. ``words`` are the bitmaps' words, the bitmap of
    entry i from ``begin[i]`` on, ``length[i]`` of them."""

    node: np.ndarray
    n: np.ndarray
    at: np.ndarray
    part: np.ndarray
    words: np.ndarray
    begin: np.ndarray
    length: np.ndarray


def _entries(batch: pa.RecordBatch, prefix: str = "") -> _Entries:
    node, n, at, part, bits = (batch.column(prefix + c).flatten() for c in ("node", "n", "at", "part", "bits"))
    sizes = pc.list_value_length(bits).to_numpy(zero_copy_only=False).astype(np.int64)
    return _Entries(*(x.to_numpy() for x in (node, n, at, part)), bits.flatten().to_numpy(),
                    np.cumsum(sizes) - sizes, sizes)


def _pairs_within(sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of the members of blocks of consecutive entries, each once."""
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = np.repeat(starts, sizes)
    i = np.repeat(first + place, place)
    j = np.arange(len(i)) - np.repeat(np.cumsum(place) - place, place) + np.repeat(first, place)
    return i, j


def _left_open(x: _Entries, i: np.ndarray, y: _Entries, j: np.ndarray, percent: int) -> np.ndarray:
    """(greater, lesser node) of the pairs of different components that may link."""
    ok = x.part[i] != y.part[j]
    i, j = i[ok], j[ok]
    n_i, n_j = x.n[i], y.n[j]
    ok = ((np.minimum(n_i, n_j) * 100 >= np.maximum(n_i, n_j) * percent)
          & (np.minimum(n_i - x.at[i], n_j - y.at[j]) >= alpha(n_i, n_j, percent)))
    i, j = i[ok], j[ok]
    found = [np.zeros((2, 0), dtype=np.int64)]
    shapes = x.length[i] * 2 ** 32 + y.length[j]
    for shape in np.unique(shapes):
        same = np.flatnonzero(shapes == shape)
        wide, high = int(shape >> 32), int(shape & (2 ** 32 - 1))
        step = max(1, WORDS_AT_ONCE // max(wide, high))
        for k in range(0, len(same), step):
            a, b = i[same[k:k + step]], j[same[k:k + step]]
            apart = unequal_bits(x.words[x.begin[a][:, None] + np.arange(wide)],
                                 y.words[y.begin[b][:, None] + np.arange(high)])
            near = apart <= x.n[a] + y.n[b] - 2 * alpha(x.n[a], y.n[b], percent)
            u, v = x.node[a[near]], y.node[b[near]]
            found.append(np.stack([np.maximum(u, v), np.minimum(u, v)]))
    return np.unique(np.concatenate(found, axis=1), axis=1)


def _block_pairs(percent: int) -> Callable:
    """Pairs of one or two blocks that components, sizes, positions and bitmaps leave open."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone = batch.column("other_node").is_null()
            single = batch.filter(alone)
            x = _entries(single)
            sizes = pc.list_value_length(single.column("node")).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            # Some blocks at a time, so that their pairs fit in memory.
            lots = np.cumsum(sizes * (sizes - 1) // 2) // PAIRS_AT_ONCE
            found = []
            for lot in np.unique(lots):
                own = lots == lot
                found.append(_left_open(x, *_both(x, _pairs_within(sizes[own], starts[own])), percent))
            double = batch.filter(pc.invert(alone))
            for r in range(len(double)):
                x, y = _entries(double.slice(r, 1)), _entries(double.slice(r, 1), "other_")
                i, j = (k.ravel() for k in np.indices((len(x.node), len(y.node))))
                found.append(_left_open(x, i, y, j, percent))
            if found:
                rows = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1])], names=["node", "centre"])

    return pairs


def _both(x: _Entries, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, _Entries, np.ndarray]:
    return pairs[0], x, pairs[1]


def _open_pairs(listed: DataFrame, leaders: DataFrame, parts: DataFrame, nodes: DataFrame,
                percent: int) -> DataFrame:
    """Pairs (node, centre) of different components that the blocks of the lists leave open."""
    home = (leaders.join(parts.withColumnsRenamed({"node": "leader", "component": "home"}), "leader", "left")
            .select("token", "size", F.coalesce("home", "leader").alias("home")))
    home = stage_via_parquet(home)
    own = stage_via_parquet(listed.join(parts, "node", "left")
                            .withColumn("part", F.coalesce("component", "node")).drop("component"))
    long = join_hot(own, home.withColumnRenamed("size", "weight"), ["token"], "weight").drop("weight")
    short = own.where(F.col("size") <= LEADER_FROM).withColumn("home", F.lit(None).cast("long"))
    at_home = F.coalesce(F.col("part") == F.col("home"), F.lit(False))
    one = F.col("size") <= BLOCK
    # Bitmaps join last, so that they are shuffled once and never staged with the entries.
    rows = long.unionByName(short, allowMissingColumns=True).join(
        nodes.select("node", "n", F.col("brief").alias("bits")), ["node", "n"]).select(
        "token", "size", "node", "n", "at", "part", "bits", F.when(one, False).otherwise(at_home).alias("at_home"),
        F.when(one, 0).otherwise(F.floor(F.log2(F.col("at") + 1))).alias("band"),
        F.when(one, 0).otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK))).alias("chunk"))
    most = F.max(F.col("n") - F.col("at"))
    blocks = stage_via_parquet(rows.groupBy("token", "size", "at_home", "band", "chunk").agg(
        *[F.collect_list(c).alias(c) for c in ("node", "n", "at", "part", "bits")], most.alias("most"),
        F.min("n").alias("n_least"), F.max("n").alias("n_most"),
        F.min("part").alias("p_least"), F.max("part").alias("p_most")))
    lists = ["node", "n", "at", "part", "bits"]
    types = dict(blocks.dtypes)
    alone = blocks.where("p_least < p_most").select(
        *lists, *[F.lit(None).cast(types[c]).alias(f"other_{c}") for c in lists])
    many = blocks.where(F.col("size") > BLOCK)
    other = many.select("token", *[F.col(c).alias(f"other_{c}") for c in many.columns if c != "token"])
    place = lambda s: F.struct(*[F.col(f"{s}{c}").alias(c) for c in ("at_home", "band", "chunk")])
    least = percent * (F.col("n_least") + F.col("other_n_least")) / F.lit(100 + percent)
    cross = (many.join(other, "token").where(place("") < place("other_"))
             .where(~(F.col("at_home") & F.col("other_at_home")))
             .where(F.least("p_least", "other_p_least") < F.greatest("p_most", "other_p_most"))
             .where(F.least("most", "other_most") >= least)
             .where((F.col("n_most") * 100 >= F.col("other_n_least") * percent)
                    & (F.col("other_n_most") * 100 >= F.col("n_least") * percent))
             .select(*lists, *[f"other_{c}" for c in lists]))
    return alone.unionByName(cross).mapInArrow(_block_pairs(percent), "node long, centre long").distinct()


def _differences(compared: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, leader, n, apart): each compared set's difference from the leader that most sets
    were compared with. Nodes of several sets are left out."""
    crowd = compared.groupBy("centre").agg(F.count("*").alias("crowd"))
    several = nodes.groupBy("node").count().where("count > 1").select("node")
    best = (compared.select("node", "centre").join(crowd, "centre").groupBy("node")
            .agg(F.max(F.struct("crowd", (-F.col("centre")).alias("minus"))).alias("top"))
            .select("node", (-F.col("top.minus")).alias("centre")))
    chosen = (compared.join(best, ["node", "centre"]).select("node", F.col("centre").alias("leader"), "n", "apart"))
    lead = chosen.select(F.col("leader").alias("node")).distinct()
    first = (nodes.join(lead, "node").join(best.select("node"), "node", "left_anti").select(
        "node", F.col("node").alias("leader"), F.col("n").cast("int").alias("n"),
        F.array().cast("array<long>").alias("apart")))
    return chosen.unionByName(first).join(several, "node", "left_anti")


def find_components(docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(node, component) of whatever links among the sets of ``nodes``."""
    compare = Compare(docs, nodes, percent)
    entries = nodes.select("node", "n", F.posexplode("tokens").alias("at", "token")).withColumn(
        "at", F.col("at").cast("long"))
    sizes = stage_via_parquet(entries.groupBy("token").agg(F.count("*").alias("size")).where("size > 1"))
    listed = stage_via_parquet(join_hot(entries, sizes, ["token"], "size"))

    # First each long list against its leader, the set with least before the shingle.
    long = listed.where(F.col("size") > LEADER_FROM)
    leaders = stage_via_parquet(long.groupBy("token", "size").agg(F.min(F.struct("at", "node", "n")).alias("l"))
                                .select("token", "size", F.col("l.node").alias("leader"),
                                        F.col("l.n").alias("n_l"), F.col("l.at").alias("at_l")))
    pairs = (join_hot(long.drop("size"), leaders, ["token"], "size").where("node <> leader")
             .where(_may_link(percent, F.col("n"), F.col("at"), F.col("n_l"), F.col("at_l")))
             .select("node", F.col("leader").alias("centre")).distinct())
    compared = stage_via_parquet(compare(pairs))
    parts = stage_via_parquet(connected_components(as_links(compared)))

    # Then what blocks leave open: by differences from a common leader, else by whole sets.
    opened = stage_via_parquet(_open_pairs(listed, leaders, parts, nodes, percent))
    if opened.isEmpty():
        return parts
    apart = stage_via_parquet(_differences(compared, nodes))
    side = lambda name, s: apart.select(
        F.col("node").alias(name), F.col("leader").alias(f"leader_{s}"), F.col("n").alias(f"n_{s}"),
        F.col("apart").alias(f"apart_{s}"))
    known = (opened.join(side("node", "x"), "node", "left").join(side("centre", "y"), "centre", "left")
             .withColumn("derived", F.coalesce(F.col("leader_x") == F.col("leader_y"), F.lit(False))))
    between = (F.size("apart_x") + F.size("apart_y") - 2 * F.size(F.array_intersect("apart_x", "apart_y")))
    derived = known.where("derived").withColumn("linked", links(F.col("n_x"), F.col("n_y"), between, percent))
    rest = known.where("not derived").select("node", "centre")
    return stage_via_parquet(extended_components(parts, as_links(derived).unionByName(as_links(compare(rest)))))


def jaccard_components(docs: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row (columns doc_id and text).

    component_id is the smallest doc_id reachable by links of at least ``percent``. Null and empty
    texts, and those without words, link with nothing and are their own component. Rows that share
    a doc_id are one document, which links by any of its texts; repeated rows have one answer each.
    Rows without a doc_id link with nothing and have a null component. An empty table gives none.
    """
    sized = stage_via_parquet(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        _sized, "doc_id string, n_shingles long, key_a long, key_b long, slots binary")
        .withColumn("doc_id", F.col("doc_id").cast("long")))
    rows = sized.where("slots is null").drop("slots")
    nodes = _index(docs, sized, percent)
    filled = rows.where("n_shingles > 0 and doc_id is not null")
    classes = stage_via_parquet(
        filled.groupBy(*SET).agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")))
    parts = extended_components(find_components(docs, nodes, percent), tied_texts(filled, classes))
    named = stage_via_parquet(classes.join(parts, "node", "left")
                              .select(*SET, "copies", F.coalesce("component", "node").alias("component_id")))
    apart = rows.where("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return join_hot(filled, named, SET, "copies").select("doc_id", "n_shingles", "component_id").unionByName(apart)
