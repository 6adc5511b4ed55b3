"""Steps along edges that no hub can fill a task with."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.functions.lineage import cut
from ripplemark.functions.ranking import few

#: Edges of one node that meet in one task on average.
DEGREE = 50_000

#: An edge table of at most so many rows is broadcast.
EDGES = 200_000


@dataclass
class Edges:
    """Edges with a `_part` where nodes have many of them, and these nodes(hub, _parts); None where no node has."""

    rows: DataFrame
    hubs: DataFrame | None

    def step(self, state: DataFrame, node: str = "node") -> DataFrame:
        """state joined with the edges that begin at its nodes; a hub's rows are copied to each part of its edges."""
        if self.hubs is None:
            return state.join(self.rows, F.col(node) == F.col("src"))
        h = few(self.hubs)
        spread = state.join(h, F.col(node) == F.col("hub"), "left").withColumn("_at", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("hub", "_parts")
        return spread.join(self.rows, (F.col(node) == F.col("src")) & (F.col("_at") == F.col("_part"))).drop("_at", "_part")


def parted(edges: DataFrame, degree: int = DEGREE, small: int = EDGES) -> Edges:
    """Edges by src, those of nodes with over `degree` of them cut into parts by the hash of dst; a small table is broadcast instead."""
    if edges.limit(small + 1).count() <= small:
        return Edges(F.broadcast(edges), None)
    hubs = cut(edges.groupBy(F.col("src").alias("hub")).agg(F.count("*").alias("n")).filter(F.col("n") > degree).select("hub", F.ceil(F.col("n") / degree).cast("int").alias("_parts")))
    if hubs.isEmpty():
        return Edges(edges, None)
    part = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("dst"), F.col("_parts"))).cast("int")
    return Edges(edges.join(few(hubs), F.col("src") == F.col("hub"), "left").withColumn("_part", part).drop("hub", "_parts"), hubs)
