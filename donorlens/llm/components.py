"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlens.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to its smallest neighbour."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    moved = edges.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether the distinct edges (a, b), a > b, are one star a component: no
    node has two centres or is both linked to a centre and a centre."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("centre")).union(edges.select("b", F.lit(0), F.lit(1)))
    most = ends.groupBy("n").agg((F.sum("up") + F.max("centre")).alias("roles")).agg(F.max("roles").alias("most")).first()["most"]
    return (most or 0) <= 1


def connected_components(links: DataFrame, left: str, right: str, member: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for every linked node.

    ``member``: the result for earlier links, which these are added to; its
    stars stand for them.  Both halves of a round are written to the shared
    folder, so that the driver plans small queries, and there are no rounds
    once the edge table is one star a component.  A node with many links is
    summed map-side and its joins are split by adaptive execution."""
    pairs = links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a <> b")
    if member is not None:
        pairs = pairs.union(member.where("node <> component").select("node", "component"))
    edges = written(pairs.distinct(), "edges")
    while not _is_star_forest(edges):
        edges = written(_large_star(edges), "edges")
        edges = written(_small_star(edges), "edges")
    return written(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct()), "components")
