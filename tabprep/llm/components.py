"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.sources.storage import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; the component is its smallest node.

    Every node points to the smallest node it knows; each round links a node's neighbours to that node and keeps the
    larger ends, so paths shorten by half or more and no node gathers its links in one place: only minima are grouped.
    Each round is written to the shared folder. Links are symmetric; self-links and repeats do no harm.
    """
    edges = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u < v").distinct()
    edges = stored(edges, "links")
    nodes = stored(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct(), "nodes")
    while True:
        # v's smallest neighbour below it; all of v's other lower neighbours, and v itself, are linked to that one.
        least = edges.groupBy("v").agg(F.min("u").alias("m"))
        joined = edges.join(least, "v")
        star = joined.select(F.col("u").alias("v"), F.col("m").alias("u")).where("u < v").union(least.select("v", F.col("m").alias("u")))
        # and one step along the pointers: v -> m -> m's own smallest.
        jump = least.alias("x").join(least.alias("y"), F.col("x.m") == F.col("y.v")).select(
            F.col("x.v").alias("v"), F.col("y.m").alias("u"))
        new = stored(star.union(jump).distinct(), "links")
        lower = new.groupBy("v").agg(F.min("u").alias("m"))
        done = new.join(lower, "v").where("u <> m").isEmpty() and \
            lower.alias("x").join(lower.alias("y"), F.col("x.m") == F.col("y.v")).isEmpty()
        edges = new
        if done:
            break
    roots = edges.groupBy("v").agg(F.min("u").alias("component")).select(F.col("v").alias("node"), "component")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
