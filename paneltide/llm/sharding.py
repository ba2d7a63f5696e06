"""Sharding by rendezvous hashing of record keys over weighted shards.

Every shard draws a number from the pair (key, shard); the record goes to the shard with the
largest weighted draw. A new shard changes no draw of the others, so it only takes rows into
itself, and a removed one only gives its rows away.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneltide.sources.io import stage_via_parquet

LAW = "key"
ROW_OVERHEAD = 16
GROUP_ROWS = 4_000
HASH_RANGE = 2.0 ** 52


def key_hash(*of: Column) -> Column:
    """52 bits of a hash of the given columns, as a long."""
    return F.shiftrightunsigned(F.xxhash64(*of), 12)


def _draw(key: Column, shard: Column, weight: Column) -> Column:
    uniform = (key_hash(key, shard) + 0.5) / HASH_RANGE
    return F.struct((-weight / F.log(uniform)).alias("draw"), (-shard).alias("minus_shard"))


def rendezvous(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """The largest draw over shards ``first``, ``first + 1``, ...; ties go to the smaller one."""
    shards = F.array(*[F.struct(F.lit(first + i).alias("shard"), F.lit(float(w)).alias("weight"))
                       for i, w in enumerate(weights)])
    return F.array_max(F.transform(shards, lambda s: _draw(key, s["shard"], s["weight"])))


def assign_shards(rows: DataFrame, key: str, weights: Sequence[float],
                  grown_weight: float | None = None) -> DataFrame:
    """Add ``shard`` and, when one more weight is given, ``grown_shard``. No shuffle.

    A null key counts as the empty text. Rows with equal keys share a shard.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    out = rows.withColumn("_best", rendezvous(text, weights))
    grown = F.lit(None).cast("int")
    if grown_weight is not None:
        grown = -F.greatest(F.col("_best"), rendezvous(text, [grown_weight], len(weights)))[
            "minus_shard"]
    return (out.withColumn("shard", (-F.col("_best")["minus_shard"]).cast("int"))
            .withColumn("grown_shard", grown.cast("int")).drop("_best"))


def number_slots(rows: DataFrame, n_shards: int, order: Sequence[str]) -> DataFrame:
    """Add ``slot``: 0, 1, ... within each shard, ordered by ``order`` (first column: a 52-bit hash).

    A shard is cut into ranges of the hash; ranges are numbered on their own and start where
    the counts of the earlier ones end. Equal rows are counted before the shuffle and laid out
    again afterwards, so copies of one row don't meet in one task as rows.
    """
    staged = stage_via_parquet(rows)
    hash_col, cols = order[0], staged.columns
    n_ranges = max(1, -(-staged.count() // (n_shards * GROUP_ROWS)))
    ranged = (staged.groupBy(*cols).agg(F.count("*").alias("_n"))
              .withColumn("_range", F.floor(F.col(hash_col) / (HASH_RANGE / n_ranges))))
    before = (Window.unboundedPreceding, -1)
    in_range = Window.partitionBy("shard", "_range").orderBy(*order)
    starts = (staged.groupBy("shard", F.floor(F.col(hash_col) / (HASH_RANGE / n_ranges))
                             .alias("_range")).agg(F.count("*").alias("_rows"))
              .withColumn("_start", F.coalesce(F.sum("_rows").over(
                  Window.partitionBy("shard").orderBy("_range").rowsBetween(*before)), F.lit(0)))
              .select("shard", "_range", "_start"))
    placed = ranged.withColumn("_before", F.coalesce(F.sum("_n").over(
        in_range.rowsBetween(*before)), F.lit(0)))
    return (placed.join(starts, ["shard", "_range"])
            .select(*cols, (F.col("_start") + F.col("_before")).alias("_first"),
                    F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)).alias("_copy"))
            .withColumn("slot", F.col("_first") + F.col("_copy")).drop("_first", "_copy"))


def shard_documents(docs: DataFrame, weights: Sequence[float],
                    grown_weight: float | None = None) -> DataFrame:
    """Shard, slot and size of every document (columns doc_id and text).

    Null text has no bytes: size 16 and checksum 0. Repeated rows are kept, each with its slot.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id",
                        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
                        F.crc32(text).cast("long").alias("text_crc32"))
    placed = assign_shards(sized, "doc_id", weights, grown_weight).withColumn(
        "_key", key_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    slots = number_slots(placed, len(weights), ["_key", "doc_id", "text_crc32", "size"])
    return slots.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
                        F.col("slot").cast("long").alias("slot"), "grown_shard")
