"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b), where component is the least node reachable.

    Each step joins a node's neighbours to its least neighbour, so that paths
    shorten by a constant factor; a written table cuts the lineage of each
    round.  The least neighbour is a min(), which is combined before the shuffle.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    state = edges
    while True:
        # large star: every neighbour above a node goes to the least of the node and its neighbours
        both = state.union(state.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every neighbour below a node, and the node, go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        new = staged(small)
        same = new.exceptAll(state).limit(1).count() == 0 and state.exceptAll(new).limit(1).count() == 0
        state = new
        if same:
            break
    return nodes.join(state.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
