"""Near-duplicate documents: MinHash with tensored banding, verified on whole shingle sets.

Two collections of ``HALVES`` short signatures are computed, each of ``HALF_ROWS`` minhashes.
Every pair of a signature of the first and one of the second is the key of one table, so
``HALVES ** 2`` tables cost ``2 * HALVES * HALF_ROWS`` minhashes. With 8 and 3, two documents
of similarity 0.85 share a table with a chance of 99.9 %, of 0.9 with 99.99 %.

Two passes find the links among the members of buckets. The first compares them with the most
central document of their bucket; that joins most groups of copies at linear cost. What is left are
members of different components in one bucket. The second pass tests them, in blocks, on parity
bitmaps: the number of unequal bits of two bitmaps is a lower bound of the number of shingles
that only one of the sets has, so pairs it rules out can't link. Only pairs it leaves open become
rows. Two blocks that lie wholly in the centre's component aren't compared.

So every pair that shares a bucket is either in one component already, or ruled out, or compared on
whole sets: nothing is lost but what banding misses. Work on bitmaps grows with the square of the
members of a bucket that are linked neither to its centre nor through it; rows and shuffles don't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneltide.llm.components import connected_components, extended_components
from paneltide.llm.shingles import (SET, Compare, alpha, as_links, bitmap, folded, join_hot, mixed, set_keys,
                                    texts_and_sets, tied_texts, unequal_bits)
from paneltide.llm.tables import text_key
from paneltide.sources.io import stage_via_parquet

LINK_PERCENT = 85
HALVES = 8
HALF_ROWS = 3
SEED = 20_240_229
#: Members of one block of a bucket.
BLOCK = 512
#: Words of bitmaps compared at once.
WORDS_AT_ONCE = 2_000_000

_N_HASHES = 2 * HALVES * HALF_ROWS


def _hash_parameters() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return (rng.integers(0, 2 ** 63, _N_HASHES, dtype=np.uint64),
            rng.integers(0, 2 ** 63, _N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def half_signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(set, 2 * HALVES) hashes of the short signatures; all sets must have members."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    masks, factors = _hash_parameters()
    out = np.zeros((len(sets), 2 * HALVES), dtype=np.uint64)
    for j in range(_N_HASHES):
        v = (flat ^ masks[j]) * factors[j]
        v ^= v >> np.uint64(32)
        least = np.minimum.reduceat(v, starts)
        half = j // HALF_ROWS
        out[:, half] = mixed(out[:, half] + least + np.uint64(half + 1))
    return out


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part, sets in texts_and_sets(batches):
        some = [s for s in sets if len(s)]
        halves = iter(half_signatures(some).view(np.int64) if some else ())
        keys = [set_keys(s) for s in sets]
        yield pd.DataFrame({
            "doc_id": part["doc_id"].to_numpy(), "text_key": part["text_key"].to_numpy(),
            "n_shingles": [len(s) for s in sets], "key_a": [k[0] for k in keys], "key_b": [k[1] for k in keys],
            "halves": [list(next(halves)) if len(s) else [] for s in sets],
            "bits": [bitmap(s) if len(s) else [] for s in sets]})


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, a 128-bit key of the set, the short signatures, the bitmap."""
    # Ids cross as text, so that a null among them doesn't turn the others into floats.
    return (docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", text_key())
            .mapInPandas(_signatures, "doc_id string, text_key long, n_shingles long, key_a long, key_b long, "
                                      "halves array<long>, bits array<long>")
            .withColumn("doc_id", F.col("doc_id").cast("long")))


def _shared_halves(nodes: DataFrame) -> DataFrame:
    """(node, centrality, a, b): the short signatures that a node shares with another.

    A table key can only be shared if both of its halves are, so halves that occur once are
    dropped before any pair of them is formed. ``centrality`` counts the documents met in all
    halves.
    """
    halves = nodes.select("node", F.posexplode("halves").alias("half", "value"))
    shared = (halves.groupBy("half", "value").agg(F.count("*").alias("n"), F.min("node").alias("least"),
                                                  F.max("node").alias("most"))
              .where("least < most").select("half", "value", "n"))
    side = lambda first: F.array_compact(F.collect_set(F.when(
        first, F.struct("half", "value"))))
    return (halves.join(shared, ["half", "value"]).groupBy("node")
            .agg(F.sum("n").alias("centrality"),
                 side(F.col("half") < HALVES).alias("a"), side(F.col("half") >= HALVES).alias("b"))
            .where((F.size("a") > 0) & (F.size("b") > 0)))


def _buckets(met: DataFrame) -> DataFrame:
    """(key, node, centre, n), one row per table of a node.

    Buckets of one node are dropped, and of buckets with the same nodes one is kept: close
    documents share most of their tables. Contents are told apart by counts and sums of hashes,
    which are combined before the shuffle.
    """
    rows = (met.withColumn("x", F.explode("a")).withColumn("y", F.explode("b"))
            .select(F.xxhash64("x", "y").alias("key"), "node", "centrality"))
    kept = (rows.groupBy("key")
            .agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"),
                 F.sum(F.shiftright(F.xxhash64("node", F.lit(1)), 24)).alias("s"),
                 F.max(F.struct("centrality", (-F.col("node")).alias("minus"))).alias("top"))
            .where("n > 1").groupBy("n", "x", "s")
            .agg(F.min(F.struct("key", (-F.col("top.minus")).alias("centre"))).alias("k"))
            .select("k.key", "k.centre", "n"))
    return rows.select("key", "node").join(kept, "key")


def _open_in_blocks(percent: int) -> Callable:
    """Pairs of one or two blocks, in different components, that sizes and bitmaps leave open."""
    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for r in batch.itertuples(index=False):
                whole = r.other_node is None
                left = (r.node, r.part, r.size, r.bits)
                right = left if whole else (r.other_node, r.other_part, r.other_size, r.other_bits)
                for x in _by_words(left):
                    for y in _by_words(right):
                        i, j = _close(x, y, percent)
                        keep = x[0][i] > y[0][j] if whole else np.ones(len(i), dtype=bool)
                        found.append(np.stack([x[0][i[keep]], y[0][j[keep]]]))
            rows = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
            yield pd.DataFrame({"node": rows.max(axis=0), "centre": rows.min(axis=0)})

    return pairs


def _by_words(block: tuple) -> Iterator[tuple]:
    """The members of a block by the length of their bitmaps, which become one array each."""
    node, part, size, bits = block
    words = np.array([len(b) for b in bits])
    for n in np.unique(words):
        at = np.flatnonzero(words == n)
        yield node[at], part[at], size[at], np.stack([bits[i] for i in at])


def _close(x: tuple, y: tuple, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in x, in y) of different components whose sizes and bitmaps allow a link."""
    i, j = np.nonzero((x[1][:, None] != y[1][None])
                      & (np.minimum(x[2][:, None], y[2][None]) * 100
                         >= np.maximum(x[2][:, None], y[2][None]) * percent))
    words = min(x[3].shape[1], y[3].shape[1])
    x_bits, y_bits = folded(x[3], words), folded(y[3], words)
    kept, step = [], max(1, WORDS_AT_ONCE // words)
    for at in range(0, len(i), step):
        a, b = i[at:at + step], j[at:at + step]
        allowed = x[2][a] + y[2][b] - 2 * alpha(x[2][a], y[2][b], percent)
        kept.append(unequal_bits(x_bits[a], y_bits[b]) <= allowed)
    ok = np.concatenate(kept) if kept else np.zeros(0, dtype=bool)
    return i[ok], j[ok]


def _open_pairs(buckets: DataFrame, nodes: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs (node, centre) of different components in one bucket that bitmaps leave open."""
    part = lambda c: F.coalesce("component", c)
    own = (buckets.select("key", "node", "n", "centre").join(parts, "node", "left")
           .select("key", "node", "n", "centre", part("node").alias("part")))
    spread = (own.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most"),
                                     F.first("centre").alias("centre"))
              .where("least < most").join(parts.withColumnRenamed("node", "centre"), "centre", "left")
              .select("key", part("centre").alias("home")))
    one = F.col("n") <= BLOCK
    rows = (own.join(spread, "key").join(nodes.select("node", F.col("n").alias("size"), "bits"), "node")
            .select("key", "n", "node", "part", "size", "bits",
                    F.when(one, False).otherwise(F.col("part") == F.col("home")).alias("at_home"),
                    F.when(one, 0).otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK))).alias("chunk")))
    lists = ["node", "part", "size", "bits"]
    blocks = stage_via_parquet(rows.groupBy("key", "n", "at_home", "chunk").agg(
        *[F.collect_list(c).alias(c) for c in lists],
        F.min("part").alias("p_least"), F.max("part").alias("p_most"),
        F.min("size").alias("s_least"), F.max("size").alias("s_most")))
    types = dict(blocks.dtypes)
    alone = blocks.where("p_least < p_most").select(
        *lists, *[F.lit(None).cast(types[c]).alias(f"other_{c}") for c in lists])
    many = blocks.where(F.col("n") > BLOCK)
    other = many.select("key", *[F.col(c).alias(f"other_{c}") for c in many.columns if c != "key"])
    place = lambda s: F.struct(F.col(f"{s}at_home").alias("at_home"), F.col(f"{s}chunk").alias("chunk"))
    cross = (many.join(other, "key").where(place("") < place("other_"))
             .where(~(F.col("at_home") & F.col("other_at_home")))
             .where(F.least("p_least", "other_p_least") < F.greatest("p_most", "other_p_most"))
             .where((F.col("s_most") * 100 >= F.col("other_s_least") * percent)
                    & (F.col("other_s_most") * 100 >= F.col("s_least") * percent))
             .select(*lists, *[f"other_{c}" for c in lists]))
    return alone.unionByName(cross).mapInPandas(_open_in_blocks(percent), "node long, centre long").distinct()


def find_components(docs: DataFrame, nodes: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """(node, component) of what is linked among ``nodes`` (node, n, halves, bits)."""
    compare = Compare(docs, nodes, percent)
    buckets = stage_via_parquet(_buckets(stage_via_parquet(_shared_halves(nodes))))
    links = as_links(compare(buckets.where("node <> centre").select("node", "centre").distinct()))
    parts = stage_via_parquet(connected_components(links))
    opened = stage_via_parquet(_open_pairs(buckets, nodes, parts, percent))
    if opened.isEmpty():
        return parts
    return stage_via_parquet(extended_components(parts, as_links(compare(opened))))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, text_key, kept of every row (columns doc_id and text).

    Equal sets are one node, its smallest doc_id; copies are never compared. Documents without
    words are linked with nothing, and neither are rows whose doc_id is null (component null).
    Rows that share a doc_id are one document, which links by any of its texts; repeated rows
    stay, each with the same answer. An empty table gives no rows.
    """
    signed = stage_via_parquet(signatures(docs))
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    nodes = stage_via_parquet(filled.groupBy(*SET).agg(
        F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("halves").alias("halves"),
        F.first("bits").alias("bits")).withColumn("n", F.col("n_shingles")))
    classes = nodes.select(*SET, "node", "copies")
    parts = extended_components(find_components(docs, nodes), tied_texts(filled, classes))
    named = stage_via_parquet(
        classes.join(parts, "node", "left")
        .select(*SET, "copies", F.coalesce("component", "node").alias("component_id")))
    columns = ["doc_id", "n_shingles", "component_id", "text_key"]
    apart = (signed.where("n_shingles = 0 or doc_id is null")
             .select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key"))
    rows = signed.select("doc_id", *SET, "text_key").where("n_shingles > 0 and doc_id is not null")
    return (join_hot(rows, named, SET, "copies").select(*columns).unionByName(apart)
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
