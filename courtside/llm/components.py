"""Connected components of a link table, by alternating large-star and small-star steps (all of it joins and minima)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, unsettle


def _open(edges: DataFrame) -> bool:
    """Whether a node still has two smaller neighbours, or a neighbour that has a smaller one itself."""
    roles = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("low")), F.struct(F.col("b").alias("node"), F.lit(0).alias("low")))).alias("r")).select("r.*")
    return bool(roles.groupBy("node").agg(F.sum("low").alias("up"), F.min("low").alias("least")).where("up > 1 or up = 1 and least = 0").take(1))


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) to (node, root) for each node that has a link and isn't its component's smallest one. Each round
    is one written table."""
    edges = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while _open(edges):
        # Large star: a node's larger neighbours go to its least one; a node without a smaller neighbour keeps its own.
        up = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "b")
        large = edges.join(up, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        # Small star: a node and its smaller neighbours go to the least of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = settle(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        unsettle(edges)
        edges = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
