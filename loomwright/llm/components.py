"""Connected components by alternating large and small stars (Kiveris et al., 2014), a durable table after each step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (a > b): large moves larger neighbours to the least one, small moves the smaller ones."""
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        pairs = pairs.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # a table between the two keeps both sides of the join plain exchanges, whose hot keys Spark can split
    least = durable(pairs.groupBy("u").agg(F.min("v").alias("v0")).select(F.col("u").alias("u0"), F.least("u", "v0").alias("m")), "star")
    moved = pairs.join(least, F.col("u") == F.col("u0"))
    if large:
        moved = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u0").alias("a"), F.col("m").alias("b")))
    return durable(moved.filter("a > b").distinct(), "edges")


def _stars(edges: DataFrame) -> bool:
    """Whether edges (a > b) are stars already: each a has one edge and is no b."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    degrees = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.sum("e.down").alias("down"))
    return degrees.filter("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node that each node of edges reaches; a root that isn't in edges as a node is left out.

    Nodes may be of any ordered type. Null ends and loops are ignored; direction and repeats don't matter. The number of
    rounds grows with the logarithm of the longest chain.
    """
    least, most = F.least(a, b), F.greatest(a, b)
    now = durable(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(most.alias("a"), least.alias("b")).filter("a > b").distinct(), "edges")
    while not _stars(now):
        now = _star(_star(now, large=True), large=False)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
