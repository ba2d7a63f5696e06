"""Connected components of a graph given by its links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneltide.sources.io import stage_via_parquet


def _mark(edges: DataFrame) -> tuple:
    """A checksum of the set of edges, to see that a step changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are hung on its smallest neighbour (or itself)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"),
                                                           F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = (down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))))
    return hung.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has a link; component is its smallest node.

    ``edges`` has columns u and v, in any direction and repeated at will. Each round is written
    to the shared folder, so its lineage stays short. Rounds grow with the logarithm of the
    longest chain; counts per node are combined before the shuffle, so a hub is no hot task.
    """
    now = stage_via_parquet(edges.where("u <> v").select("u", "v").distinct())
    mark = _mark(now)
    while mark[0]:
        now = stage_via_parquet(_small_star(_large_star(now)))
        after = _mark(now)
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("v").alias("node")).distinct()
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(roots.select("node", F.col("node").alias("component"))))


def extended_components(parts: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of a graph whose components are ``parts`` before ``links`` (u, v) join it.

    Only links between different components go through the rounds. ``parts`` must be staged.
    """
    side = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}"))
    whole = lambda c: F.coalesce(f"part_{c}", c)
    between = stage_via_parquet(
        links.join(side("u"), "u", "left").join(side("v"), "v", "left")
        .select("u", "v", whole("u").alias("pu"), whole("v").alias("pv")).where("pu <> pv"))
    if between.isEmpty():
        return parts
    merged = stage_via_parquet(connected_components(between.select(F.col("pu").alias("u"), F.col("pv").alias("v"))))
    above = merged.select(F.col("node").alias("component"), F.col("component").alias("above"))
    known = parts.join(above, "component", "left").select("node", F.coalesce("above", "component").alias("component"))
    # Nodes that had no link before: they were components of their own.
    new = merged.join(parts.select("node"), "node", "left_anti")
    return known.unionByName(new)
