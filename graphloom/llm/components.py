"""Connected components of links, on the cluster: large-star and small-star steps until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import common


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Links each node's neighbours (only smaller ones, if small; only larger ones otherwise) to its smallest neighbour or itself."""
    if small:
        # Each edge hangs on its larger end.
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Stored, so that Spark can split the rows of a star's centre among tasks in the join.
    least = common.materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b), longs, to (node, root) for all nodes that have an edge; the root is the smallest node that can be reached."""
    state = common.materialize(edges.filter("a <> b").select("a", "b").distinct(), "links")
    before = None
    while True:
        # Steps keep the components; the state is a set of stars when a round does not change it.
        sums = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == before or not sums[0]:
            break
        before = tuple(sums)
        state = common.materialize(_star(_star(state, small=False), small=True), "stars")
    roots = state.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(state.select("b", "b").distinct())
