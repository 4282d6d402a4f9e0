"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, drop


def _min_neighbour(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour, or itself. Map-side combined: a node of any degree is one row per task."""
    return edges.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_min_neighbour(both), F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    joined = down.join(_min_neighbour(down), F.col("u") == F.col("w"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


#: Edges of a task; a graph of few edges isn't spread over all shuffle partitions.
TASK_EDGES = 100_000


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) of every node of edges(u, v): component is the smallest node that can be reached.

    Nodes without edges aren't returned; loops, repeated and reversed edges are allowed, edges with a null end are
    ignored, no edges give no rows. Each round is two shuffles on the edges, whose number never grows, and is cut into
    the shared checkpoint folder, where it replaces the round before. The rounds end when the set of edges stays the same.
    """
    edges = cut(edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct())
    tasks = max(8, -(-edges.count() // TASK_EDGES))
    edges, seen = edges.coalesce(tasks), None
    last = None
    for _ in range(max_rounds):
        stored = cut(_small_star(_large_star(edges).coalesce(tasks)).coalesce(tasks))
        now = tuple(stored.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if last is not None:
            drop(last)
        edges = last = stored
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
