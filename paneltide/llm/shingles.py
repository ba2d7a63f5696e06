"""Shingle sets of texts, keys and parity bitmaps of them, and their comparison in pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneltide.sources.io import stage_via_parquet

SHINGLE = 3
TEXTS_AT_ONCE = 64
#: Bits of a parity bitmap per member of its set, at least.
BITS_PER_MEMBER = 4
#: A list of this many ids is some 10 MB as a broadcast table; longer ones are shuffled.
BROADCAST_IDS = 500_000
#: Keys with more rows than this are joined by a broadcast, if they are few, not by a shuffle.
HOT = 10_000
BROADCAST_HOT = 100_000
SALTS = 8

#: Columns that tell sets apart.
SET = ["key_a", "key_b", "n_shingles"]

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mixed(x: np.ndarray) -> np.ndarray:
    for factor in _MIX:
        x = (x ^ (x >> np.uint64(33))) * factor
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted 64-bit hashes of the distinct shingles of each text.

    Words are split at ASCII white space and A-Z lower-cased, on bytes. Fewer words than a
    shingle make one shingle of all of them, none an empty set.
    """
    words = [t.encode().lower().split() for t in texts]
    flat = np.array([w for ws in words for w in ws] + [b""], dtype=object)[:-1]
    hashes = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    out, start = [], 0
    for ws in words:
        h = hashes[start:start + len(ws)]
        start += len(ws)
        n = min(SHINGLE, len(h))
        if n == 0:
            out.append(np.zeros(0, dtype=np.uint64))
            continue
        s = np.full(len(h) - n + 1, np.uint64(n))
        for i in range(n):
            s = mixed(s + h[i:len(h) - n + 1 + i])
        out.append(np.unique(s))
    return out


def texts_and_sets(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Some rows at a time with the sets of their column ``text``; null counts as empty."""
    for batch in batches:
        for at in range(0, len(batch), TEXTS_AT_ONCE):
            part = batch.iloc[at:at + TEXTS_AT_ONCE]
            yield part, shingle_sets(part["text"].fillna("").tolist())


def set_keys(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, from sums over their hashes."""
    sums = (mixed(s).sum(dtype=np.uint64), mixed(s + np.uint64(1)).sum(dtype=np.uint64))
    return tuple(int(x.view(np.int64)) for x in sums)


def alpha(n_x: np.ndarray, n_y: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of linked sets of these sizes."""
    return -(-percent * (n_x + n_y) // (100 + percent))


def bitmap(s: np.ndarray) -> np.ndarray:
    """A parity bit for each of 2**k places: whether an odd number of members falls on it."""
    bits = max(64, 1 << (BITS_PER_MEMBER * len(s) - 1).bit_length())
    counts = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmaps (..., more words) in so many words: halves are laid over each other."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def unequal_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the number of members that only one of two sets has: each flips a bit."""
    words = min(a.shape[-1], b.shape[-1])
    return np.bitwise_count((folded(a, words) ^ folded(b, words)).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def links(n_x: Column, n_y: Column, apart: Column, percent: int) -> Column:
    """Whether sets of these sizes link if ``apart`` members are in one only; whole numbers."""
    return (n_x + n_y - apart) * 100 >= (n_x + n_y + apart) * percent


def join_hot(left: DataFrame, right: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Inner join on a unique key of ``right``, whose column ``weight`` has the rows of a key in
    ``left``. Keys of more than ``HOT`` rows don't go through the shuffle. Both must be staged."""
    hot = right.where(F.col(weight) > HOT)
    n_hot = hot.count()
    if not 0 < n_hot <= BROADCAST_HOT:
        return left.join(right, on)
    cold = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(F.col(weight) <= HOT), on)
    return left.join(F.broadcast(hot), on).unionByName(cold)


def tied_texts(filled: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) between a doc_id that has several texts and the nodes of their sets.

    ``filled`` has doc_id and ``SET`` of each row, ``classes`` the node of each set.
    """
    several = (filled.select("doc_id", *SET).distinct().groupBy("doc_id").agg(F.count("*").alias("texts"))
               .where("texts > 1").select("doc_id"))
    return (filled.join(several, "doc_id", "left_semi").join(classes, SET)
            .select(F.col("doc_id").alias("u"), F.col("node").alias("v")).where("u <> v"))


class Compare:
    """Compares pairs (node, centre) on their whole sets, made anew from the texts in pairs.

    ``nodes`` has node, n and bits of every different set; a node may have several sets.
    """

    def __init__(self, docs: DataFrame, nodes: DataFrame, percent: int) -> None:
        self.docs, self.nodes, self.percent = docs.where("doc_id is not null"), nodes, percent

    def hopeful(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sizes and bitmaps allow a link."""
        percent = self.percent

        def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                n_x, n_y = batch["n_x"].to_numpy(), batch["n_y"].to_numpy()
                allowed = n_x + n_y - 2 * alpha(n_x, n_y, percent)
                apart = [unequal_bits(a, b) for a, b in zip(batch["bits_x"], batch["bits_y"], strict=True)]
                yield batch.loc[np.array(apart, dtype=np.int64) <= allowed, ["node", "centre"]]

        side = lambda name, s: self.nodes.select(
            F.col("node").alias(name), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
        sized = F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent
        return (pairs.join(side("node", "x"), "node").join(side("centre", "y"), "centre").where(sized)
                .mapInPandas(test, "node long, centre long").distinct())

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """(node, centre, n, linked, apart): ``apart`` is what only one of the two sets has."""
        pairs = stage_via_parquet(self.hopeful(pairs))
        wanted = stage_via_parquet(pairs.select(F.col("node").alias("doc_id")).union(pairs.select("centre")).distinct())
        few = wanted.count() <= BROADCAST_IDS
        texts = self.docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
        # Repeated rows would multiply the pairs.
        sets = stage_via_parquet(texts.mapInPandas(_whole, "node long, key_a long, key_b long, s array<long>")
                                 .where("size(s) > 0").groupBy("node", "key_a", "key_b")
                                 .agg(F.first("s").alias("s")).select("node", "s"))
        # A centre may be in any share of the pairs: its set is laid out for several tasks.
        centres = sets.join(pairs.select(F.col("centre").alias("node")).distinct(), "node", "left_semi").select(
            F.col("node").alias("centre"), F.col("s").alias("t"),
            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        both = (pairs.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
                .join(sets, "node").join(centres, ["centre", "salt"])
                .withColumn("apart", F.array_union(F.array_except("s", "t"), F.array_except("t", "s"))))
        return both.select("node", "centre", F.size("s").alias("n"), links(
            F.size("s"), F.size("t"), F.size("apart"), self.percent).alias("linked"), "apart")


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part, sets in texts_and_sets(batches):
        keys = [set_keys(s) for s in sets]
        yield pd.DataFrame({"node": part["doc_id"].to_numpy(), "key_a": [k[0] for k in keys],
                            "key_b": [k[1] for k in keys], "s": [s.view(np.int64) for s in sets]})


def as_links(compared: DataFrame) -> DataFrame:
    return compared.where("linked").select(F.col("node").alias("u"), F.col("centre").alias("v"))
