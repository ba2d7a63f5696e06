"""Product codes of vectors, with nearest codebook entries found by slicing and intersecting bitmasks.

Vectors become whole numbers and are cut into parts; each part position has a codebook of at most
64 entries. Per dimension of a part the entries' coordinates are sorted, and every prefix of that
order carries the uint64 mask of its entries. For a query the distance to some near entry gives an
initial radius; in each dimension the two ends of the query's range are looked up, the masks of the
two prefixes differ in just the entries inside the range, and the AND over the dimensions leaves
every entry of the box around the query. The entry that gave the radius is in it, so the box is
never empty and holds the nearest one: the candidates are compared exactly, and nothing else is.

A pass over the vectors adds up, per Arrow batch, the parts that each entry got; the sums of all
batches are combined by Spark, so a pass sends the driver one row per entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneltide.sources.io import stage_via_parquet

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Scaled components are below this, so that distances and sums stay exact 64-bit numbers.
LARGEST = 2 ** 27
#: Up to this many labels their sums are broadcast, beyond it joined by a salted shuffle.
BROADCAST_LABELS = 100_000
SALTS = 16


class Slices(NamedTuple):
    """A codebook (entries, width) ready for look-ups."""

    book: np.ndarray
    sorted: np.ndarray        # (width, entries) coordinates in order
    order: np.ndarray         # (width, entries) entry of each place
    masks: np.ndarray         # (width, entries + 1) entries of each prefix


def slices(book: np.ndarray) -> Slices:
    order = np.argsort(book, axis=0, kind="stable").T
    masks = np.zeros((book.shape[1], len(book) + 1), dtype=np.uint64)
    masks[:, 1:] = np.bitwise_or.accumulate(np.uint64(1) << order.astype(np.uint64), axis=1)
    return Slices(book, np.take_along_axis(book.T, order, axis=1), order, masks)


def _distance(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((x - entries) ** 2).sum(axis=1)


def nearest(x: np.ndarray, cut: Slices) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry to each row, ties to the lower index."""
    width, last = x.shape[1], len(cut.book) - 1
    bound = np.full(len(x), np.iinfo(np.int64).max)
    for j in range(width):
        at = np.minimum(np.searchsorted(cut.sorted[j], x[:, j]), last)
        bound = np.minimum(bound, _distance(x, cut.book[cut.order[j, at]]))
    radius = np.sqrt(bound).astype(np.int64) + 1
    mask = np.full(len(x), np.iinfo(np.uint64).max, dtype=np.uint64)
    for j in range(width):
        low = np.searchsorted(cut.sorted[j], x[:, j] - radius, "left")
        high = np.searchsorted(cut.sorted[j], x[:, j] + radius, "right")
        mask &= cut.masks[j, high] ^ cut.masks[j, low]
    index = np.zeros(len(x), dtype=np.int64)
    best = np.full(len(x), np.iinfo(np.int64).max)
    rows = np.arange(len(x))
    while len(rows):
        left = mask[rows]
        lowest = np.bitwise_count((left & (~left + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        d = _distance(x[rows], cut.book[lowest])
        better = d < best[rows]                     # ascending indexes: a tie keeps the lower
        best[rows[better]], index[rows[better]] = d[better], lowest[better]
        mask[rows] = left & (left - np.uint64(1))
        rows = rows[mask[rows] != 0]
    return index, best


def whole_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v): the kept rows, components as floors of ``SCALE`` times their values.

    A row is kept if its vector and all components are there, finite, and below ``LARGEST`` when
    scaled. Of vectors of several lengths those as long as the first by vec_id count.
    """
    whole = F.transform("embedding", lambda x: x.cast("double") * SCALE)
    bad = F.exists("w", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))
    return (rows.where(F.col("embedding").isNotNull()).select("vec_id", "label", whole.alias("w"))
            .where(~bad).select("vec_id", "label", F.transform("w", lambda x: F.floor(x)).alias("v")))


def _parts(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """(rows, PARTS, width) of a batch's column v."""
    column = batch.column("v")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), PARTS, width)


def _sums(books: list[Slices], width: int) -> Callable:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, ENTRIES, width + 1), dtype=np.int64)
        for batch in batches:
            if len(batch):
                parts = _parts(batch, width)
                for p, cut in enumerate(books):
                    index, _ = nearest(parts[:, p], cut)
                    np.add.at(total[p, :, :width], index, parts[:, p])
                    total[p, :, width] += np.bincount(index, minlength=ENTRIES)
        p, e = np.nonzero(total[:, :, width])
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))],
            names=["part", "entry", "sums"])

    return add


def _code(books: list[Slices], width: int) -> Callable:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            parts = _parts(batch, width)
            found = [nearest(parts[:, p], cut) for p, cut in enumerate(books)]
            text = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"),
                 pa.array([row.tobytes().hex() for row in text], pa.string()),
                 pa.array(sum(d for _, d in found), pa.int64())],
                names=["vec_id", "label", "code", "error"])

    return code


def train(vectors: DataFrame, width: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks (entries, width) of all parts after so many rounds over ``vectors``."""
    first = (vectors.where("vec_id is not null").orderBy("vec_id", "v").limit(ENTRIES)
             .orderBy("vec_id", "v").select("v").collect())
    start = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), PARTS, width)
    books = [start[:, p].copy() for p in range(PARTS)]
    for _ in range(rounds):
        sums = vectors.select("v").mapInArrow(_sums([slices(b) for b in books], width),
                                              "part int, entry int, sums array<long>")
        added = sums.groupBy("part", "entry").agg(F.array(*[
            F.sum(F.col("sums")[i]) for i in range(width + 1)]).alias("sums"))
        for r in added.collect():                   # at most one row per entry
            books[r["part"]][r["entry"]] = [s // r["sums"][width] for s in r["sums"][:width]]
    return books


def encode(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row.

    ``rows`` has vec_id, embedding and label. Null vectors, those with null or non-finite
    components (or of ``LARGEST`` and more when scaled), and those of another length than the
    first are dropped. Rows that share a vec_id are coded each and are ordered by their vectors
    where the first codebook is chosen; a null vec_id is coded but never in it. Fewer than
    ``ENTRIES`` ids make a smaller codebook, none (or an empty table) no rows. A length that isn't
    a multiple of ``PARTS`` is an error.
    """
    kept = whole_vectors(rows)
    head = kept.where("vec_id is not null").orderBy("vec_id", "v").limit(1).collect()
    if not head:
        return (kept.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                                     F.lit(0).cast("long").alias("label_error"),
                                     F.lit("").alias("codebooks_sha256")))
    size = len(head[0]["v"])
    if not size or size % PARTS:
        raise ValueError(f"vectors of {size} components can't be cut into {PARTS} equal parts")
    width = size // PARTS
    vectors = kept.where(F.size("v") == size)
    books = train(vectors, width)
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()
    coded = stage_via_parquet(vectors.mapInArrow(
        _code([slices(b) for b in books], width),
        f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code string, error long"))
    errors = stage_via_parquet(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    right = errors.withColumnRenamed("label", "_label")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if errors.count() <= BROADCAST_LABELS:
        right = F.broadcast(right)
    else:
        coded = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
        right = right.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same = same & (F.col("_salt") == F.col("_to"))
    return coded.join(right, same, "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
