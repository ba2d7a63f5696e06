"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors get one more component that makes all their lengths equal, so the largest inner product
is the least Euclidean distance. Each table hashes a vector by the cells that random (Gaussian,
hence 2-stable) projections fall into. A query visits its own bucket and those with some cells
moved by one, in the order of the estimated chance of success: the sum of the squared distances
from the query's projections to the cells. Candidates of all tables are scored exactly.

How many buckets a query visits is fitted on a bounded sample, so that recall there reaches a
target; every vector is indexed. A query that met fewer than k candidates is compared with all
vectors in blocks, so no answer is short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneltide.sources.io import stage_via_parquet

TABLES = 4
PROJECTIONS = 6           # per table
CELL_WIDTH = 2.0          # in standard deviations of the projections
BLOCK_PROJECTIONS = 2     # projections whose cells name the block of a bucket
BLOCK_CELLS = 8           # cells further out share the outermost block
TARGET_RECALL = 0.96
SAMPLE_VECTORS = 8_000    # that the number of probes is fitted on
SAMPLE_QUERIES = 200
BLOCK_ROWS = 8_192        # vectors of a block that one task compares, on average
BLOCK_QUERIES = 4_096     # queries of a block that one task compares, on average
SEED = 5
_MOVES = np.array(list(product((-1, 0, 1), repeat=PROJECTIONS)))
_BLOCK_BASE = 2 * BLOCK_CELLS + 1
_KEY_MULTIPLIER = 1_000_003

_RESULT = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Hashing:
    """Projections (components + 1, tables, projections), shifts, cell width and probes."""

    directions: np.ndarray
    shifts: np.ndarray
    width: float
    length: float             # the largest length of an indexed vector
    probes: int = 0

    def places(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """(vector, table, projection) in units of cells."""
        norms = np.linalg.norm(vectors, axis=1)
        if query:             # only the direction of a query matters
            vectors = vectors * (self.length / norms)[:, None]
            more = np.zeros(len(vectors))
        else:
            more = np.sqrt(np.maximum(self.length ** 2 - norms ** 2, 0))
        full = np.concatenate([vectors, more[:, None]], axis=1)
        return (np.tensordot(full, self.directions, axes=1) + self.shifts) / self.width


def _stack(vectors: pd.Series, size: int) -> np.ndarray:
    return (np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors)
            else np.zeros((0, size)))


def _bucket(cells: np.ndarray) -> np.ndarray:
    """One number for the cells of a table's projections (last axis)."""
    key = np.zeros(cells.shape[:-1], dtype=np.int64)
    for i in range(cells.shape[-1]):
        key = key * _KEY_MULTIPLIER + cells[..., i]
    return key


def _block(cells: np.ndarray, table: np.ndarray | int) -> np.ndarray:
    """The block of a bucket: its table and the cells of its first projections."""
    key = np.zeros(cells.shape[:-1], dtype=np.int64) + table
    for i in range(BLOCK_PROJECTIONS):
        key = key * _BLOCK_BASE + np.clip(cells[..., i], -BLOCK_CELLS, BLOCK_CELLS) + BLOCK_CELLS
    return key


def _probes(places: np.ndarray, n: int) -> np.ndarray:
    """(query, n, projection): cells of one table to visit, the likeliest first."""
    cells = np.floor(places)
    inside = places - cells
    cost = np.stack([inside ** 2, np.zeros_like(inside), (1 - inside) ** 2])   # moves -1, 0, 1
    total = sum(cost[_MOVES[:, i] + 1, :, i] for i in range(PROJECTIONS)).T
    first = np.argsort(total, axis=1, kind="stable")[:, :n]
    return cells.astype(np.int64)[:, None, :] + _MOVES[first]


def _top(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row, with all that tie with the last of them."""
    if scores.shape[1] <= k:
        return tuple(x.ravel() for x in np.indices(scores.shape))
    last = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    return np.nonzero(scores >= last[:, None] - 1e-9)


def _best(query_ids: np.ndarray, queries: np.ndarray, vec_ids: np.ndarray, vectors: np.ndarray,
          pairs: list[tuple[np.ndarray, np.ndarray]], k: int) -> pd.DataFrame:
    """The k best vectors per query among the given (query row, vector row) candidates."""
    if not pairs:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    q, v = (np.concatenate(x) for x in zip(*pairs, strict=True))
    other = query_ids[q] != vec_ids[v]
    q, v = q[other], v[other]
    # Summed pair by pair, so that equal vectors get equal scores in any block.
    score = np.concatenate([(queries[q[i:i + 65536]] * vectors[v[i:i + 65536]]).sum(axis=1)
                            for i in range(0, len(q), 65536)] or [np.zeros(0)])
    found = pd.DataFrame({"query_id": query_ids[q], "vec_id": vec_ids[v], "score": score})
    found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return found.drop_duplicates(["query_id", "vec_id"]).groupby("query_id").head(k)


def _compare(k: int, size: int):
    """A function of the vectors and the queries of one block: the k best of each query there."""
    def compare(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asked):
            return _best(*[np.zeros(0)] * 4, [], k)
        data = data.sort_values("bucket", kind="stable")
        vectors, queries = _stack(data["vector"], size), _stack(asked["vector"], size)
        buckets, starts = np.unique(data["bucket"].to_numpy(), return_index=True)
        ends = np.append(starts[1:], len(data))
        lists = asked["buckets"].tolist()
        wanted = np.concatenate(lists)
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(wanted, kind="stable")
        wanted, owner = wanted[order], owner[order]
        pairs = []
        for bucket, a, b in zip(buckets, starts, ends, strict=True):
            rows = owner[np.searchsorted(wanted, bucket):np.searchsorted(wanted, bucket, "right")]
            if len(rows):
                # One more than k: the query itself may be among them.
                i, j = _top(queries[rows] @ vectors[a:b].T, k + 1)
                pairs.append((rows[i], a + j))
        return _best(asked["query_id"].to_numpy(), queries, data["vec_id"].to_numpy(), vectors,
                     pairs, k)

    return compare


def usable(rows: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, vector) of the rows that take part, and the number of components.

    Left out: null ids and vectors, vectors with null or non-finite components, zero vectors,
    and those whose length isn't the most frequent one (the larger of equally frequent ones).
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) != float("inf")))
    kept = (rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
            .where(F.exists("embedding", lambda x: x != 0)))
    sizes = (kept.groupBy(F.size("embedding").alias("size")).count()
             .orderBy(F.desc("count"), F.desc("size")).first())
    size = sizes["size"] if sizes else 0
    return (kept.where(F.size("embedding") == size)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.col("embedding").alias("vector")), size)


def fit_hashing(vectors: DataFrame, size: int, k: int) -> Hashing:
    """Cells from a sample of ``SAMPLE_VECTORS``; the fewest probes that reach the target there."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") ** 2))
    length = vectors.agg(F.max(norm)).first()[0]
    sample = (vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_VECTORS)
              .select("vector").toPandas())
    x = _stack(sample["vector"], size)
    rng = np.random.default_rng(SEED)
    directions = rng.normal(size=(size + 1, TABLES, PROJECTIONS))
    plain = Hashing(directions, np.zeros((TABLES, PROJECTIONS)), 1.0, length)
    width = CELL_WIDTH * max(float(plain.places(x, False).std()), 1e-12)
    made = Hashing(directions, rng.uniform(0, width, (TABLES, PROJECTIONS)), width, length)
    asked = x[:SAMPLE_QUERIES]
    scores = asked @ x.T
    np.fill_diagonal(scores, -np.inf)
    best = np.argsort(-scores, axis=1)[:, :min(k, len(x) - 1)]
    data = _bucket(np.floor(made.places(x, False)).astype(np.int64))
    places = made.places(asked, True)
    visited = np.full(best.shape, len(_MOVES))       # rank of the probe that meets a neighbour
    for t in range(TABLES):
        probes = _bucket(_probes(places[:, t], len(_MOVES)))
        for i, near in enumerate(best):
            meets = probes[i][:, None] == data[near, t][None, :]
            visited[i] = np.minimum(visited[i], np.where(meets.any(axis=0), meets.argmax(axis=0),
                                                         len(_MOVES)))
    n = int(np.quantile(visited, TARGET_RECALL, method="higher")) + 1 if visited.size else 1
    return Hashing(made.directions, made.shifts, made.width, length, min(n, len(_MOVES)))


def _counts(rows: DataFrame) -> dict[int, int]:
    """Rows per block. There are at most TABLES * (2 * BLOCK_CELLS + 1) ** 2 blocks."""
    return {r["block"]: r["count"] for r in rows.groupBy("block").count().collect()}


def nearest(rows: DataFrame, is_query, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (columns vec_id, embedding).

    ``is_query`` is a condition on vec_id. Ties go to the smaller vec_id; a vec_id that occurs
    repeatedly counts once, and a query's own never. What ``usable`` leaves out takes no part.
    """
    spark = rows.sparkSession
    vectors, size = usable(rows)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not size:
        return empty
    hashing = fit_hashing(vectors, size, k)
    queries = vectors.where(is_query).dropDuplicates(["vec_id"])

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = np.floor(hashing.places(_stack(batch["vector"], size), False)).astype(np.int64)
            for t in range(TABLES):
                yield batch.assign(block=_block(cells[:, t], t), bucket=_bucket(cells[:, t]))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places = hashing.places(_stack(batch["vector"], size), True)
            found = []
            for t in range(TABLES):
                cells = _probes(places[:, t], hashing.probes)
                blocks, buckets = _block(cells, t), _bucket(cells)
                for i in range(len(batch)):
                    for block in np.unique(blocks[i]):
                        found.append((i, block, buckets[i][blocks[i] == block]))
            rows, block, lists = zip(*found, strict=True) if found else ((), (), ())
            picked = batch.iloc[list(rows)].rename(columns={"vec_id": "query_id"})
            yield picked.assign(block=list(block), buckets=list(lists))

    indexed = vectors.mapInPandas(index, "vec_id long, vector array<float>, block long, bucket long")
    probed = queries.mapInPandas(
        probe, "query_id long, vector array<float>, block long, buckets array<long>")
    found = _in_blocks(indexed, probed, _counts(indexed), _counts(probed), k, size)
    found = stage_via_parquet(found)
    ranked = _ranked(found, k)
    # Queries that met too few: compared with all vectors, in blocks.
    n_vectors = vectors.select("vec_id").distinct().count()
    met = ranked.groupBy("query_id").agg(F.count("*").alias("met"))
    short = (queries.join(met.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
             .where(F.coalesce("met", F.lit(0)) < min(k, n_vectors - 1)))
    short = stage_via_parquet(short)
    n_short = short.count()
    if n_short:
        data = vectors.select("vec_id", F.col("vector").alias("vector"), F.lit(0).cast("long").alias("block"),
                              F.lit(0).cast("long").alias("bucket"))
        asked = short.select(F.col("vec_id").alias("query_id"), "vector",
                             F.lit(0).cast("long").alias("block"),
                             F.array(F.lit(0).cast("long")).alias("buckets"))
        whole = _in_blocks(data, asked, {0: n_vectors}, {0: n_short}, k, size)
        ranked = _ranked(found.unionByName(whole), k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _in_blocks(data: DataFrame, asked: DataFrame, n_data: dict[int, int], n_asked: dict[int, int],
               k: int, size: int) -> DataFrame:
    """Compare the vectors and queries of each block; large blocks are cut both ways."""
    spark = data.sparkSession
    cuts = [(block, -(-n // BLOCK_ROWS), -(-n_asked[block] // BLOCK_QUERIES))
            for block, n in n_data.items() if block in n_asked]
    # One row per block, whose number has a fixed bound.
    sizes = F.broadcast(spark.createDataFrame(cuts, "block long, n_parts int, n_lots int"))
    parts = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    spread = (data.join(sizes, "block")
              .withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("n_parts")).cast("int"))
              .withColumn("lot", parts("n_lots")).drop("n_parts", "n_lots"))
    lots = (asked.join(sizes, "block")
            .withColumn("lot", F.pmod(F.xxhash64("query_id"), F.col("n_lots")).cast("int"))
            .withColumn("part", parts("n_parts")).drop("n_parts", "n_lots"))
    keys = ["block", "part", "lot"]
    return (spread.groupBy(*keys).cogroup(lots.groupBy(*keys))
            .applyInPandas(_compare(k, size), _RESULT))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """At most k per query come from each block, so a query's rows here are few."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
