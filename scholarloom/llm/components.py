"""Connected components of a table of links, by contraction: no component is gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarloom.llm.common import stored

JUMPS = 2


def component_of(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b); root is the component's smallest node.

    Each round points every node to its smallest neighbour, doubles these pointers until they all end at a node that points to itself, and replaces
    both ends of all links by that node; links within one node vanish. At least half of the nodes that still have links go in each round, and the
    doublings follow the logarithm of the longest chain of pointers. A node with very many links meets its pointer in an equality join, which Spark can split.
    """
    edges = stored(links.where(F.col("a") != F.col("b")), "links")
    nodes = edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).distinct()
    pointed = nodes.select("node", F.col("node").alias("root"))
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("up"))
        least, moving = stored(least, "pointers"), True
        while moving:
            for _ in range(JUMPS):
                next_up = least.select(F.col("a").alias("up"), F.col("up").alias("top"))
                least = least.join(next_up, "up", "left").select("a", F.coalesce("top", "up").alias("up"), F.coalesce(F.col("top") != F.col("up"), F.lit(False)).alias("moved"))
            jumped = stored(least, "pointers")
            least, moving = jumped.drop("moved"), not jumped.where("moved").isEmpty()
        pointed = stored(pointed.join(least.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        ends = edges.join(least.select("a", F.col("up").alias("x")), "a").join(least.select(F.col("a").alias("b"), F.col("up").alias("y")), "b")
        edges = stored(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where(F.col("a") != F.col("b")).distinct(), "links")
    return pointed
