"""Connected components of large edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_GROUPS, staged, unstage


def _oriented(edges: DataFrame) -> DataFrame:
    """From the larger end ``u`` to the smaller ``v``, each once."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (u, v), root being the smallest node it can reach.

    Alternates large-star and small-star steps until the edges are stars. A step
    takes minima per node and joins them back to the edges, so that no node's
    neighbours are gathered in one place: the minima are combined before they are
    shuffled, and Spark splits a node whose edges overfill a partition of the join.
    """
    now = staged(_oriented(edges), "edges")
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first.withColumnRenamed("u", "c"), F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = staged(_oriented(small.union(first.select("u", F.col("m").alias("v")))), "edges")
        unstage(now)
        now = after
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark or not new[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        mark = new


def roots_of(links: DataFrame) -> DataFrame:
    """A staged table of the components of links, which are computed once."""
    linked = staged(links, "links")
    roots = staged(components(linked), "roots")
    unstage(linked)
    return roots


def small(df: DataFrame, most: int = 5 * BROADCAST_GROUPS) -> DataFrame:
    """To be broadcast, if there are no more rows than ``most``."""
    return F.broadcast(df) if df.count() <= most else df


def least_of(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """A staged table (_node, _least): the smallest ``least`` of each node's component. ``nodes``: node, least.

    Only nodes that have links are joined by their root, of which many may have the same.
    """
    linked = nodes.join(roots, "node")
    least = staged(linked.groupBy("root").agg(F.min("least").alias("_least")), "least")
    changed = linked.join(small(least), "root").select("node", "_least")
    return staged(nodes.join(changed, "node", "left").select(F.col("node").alias("_node"), F.coalesce("_least", "least").alias("_least")), "groups")
