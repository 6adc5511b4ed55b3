"""Knowledge graph as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.functions.lineage import cut
from ripplemark.functions.quantiles import exact_quantiles

#: The type of a relation's source and target nodes.
SIDES = {"LOCATED_IN": ("supplier", "nation"), "IN_REGION": ("nation", "region"), "SUPPLIES": ("supplier", "brand"), "BUYS_FROM": ("customer", "supplier")}


def kg_edges(edges: DataFrame) -> DataFrame:
    """Trimmed ids, no loops, null ends or weights of 0 and less; duplicates merged by their greatest weight."""
    e = edges.select(F.trim("src").alias("src"), F.trim("dst").alias("dst"), "rel", "w")
    return e.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> '' AND dst <> '' AND src <> dst AND w > 0").groupBy("src", "dst", "rel").agg(F.max("w").alias("w"))


def kg_nodes(edges: DataFrame, universe: DataFrame | None = None, sides: dict = SIDES) -> DataFrame:
    """Endpoints and the universe's nodes(node, ntype); the type is the universe's, else the least that a relation gives."""
    kind = lambda i: F.create_map(*[F.lit(x) for r, s in sides.items() for x in (r, s[i])])[F.col("rel")]
    ends = edges.select(F.col("src").alias("node"), kind(0).alias("t")).union(edges.select("dst", kind(1))).groupBy("node").agg(F.min("t").alias("t"))
    if universe is None:
        return ends.select("node", F.coalesce("t", F.lit("unknown")).alias("ntype"))
    known = universe.groupBy("node").agg(F.min("ntype").alias("u"))
    return ends.join(known, "node", "full_outer").select("node", F.coalesce("u", "t", F.lit("unknown")).alias("ntype"))


def symmetrise(edges: DataFrame) -> DataFrame:
    """Both directions, one weight for each ordered pair: the greatest."""
    return edges.select("src", "dst", "w").union(edges.select("dst", "src", "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))


def transition(edges: DataFrame) -> DataFrame:
    """p = w / sum of w by source; the sum is aggregated and joined, so that a hub's edges need not meet in one task."""
    total = edges.groupBy("src").agg(F.sum("w").alias("_t"))
    return edges.join(total, "src").withColumn("p", F.col("w") / F.col("_t")).drop("_t")


def build_kg(seed_edges: DataFrame, universe: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes, and symmetric edges with their transition probabilities."""
    edges = kg_edges(seed_edges)
    return kg_nodes(edges, universe), transition(symmetrise(edges))


def seed_vector(tags: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Restart weights by event, summing to 1, over known nodes; and the number of unknown ones. tags(event_id, node, w)."""
    rows = tags.join(nodes.select("node").distinct().withColumn("_k", F.lit(1)), "node", "left")
    known = rows.filter("_k = 1 AND w > 0").groupBy("event_id", "node").agg(F.sum("w").alias("w"))
    vector = known.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("event_id")))
    return vector, rows.groupBy("event_id").agg(F.sum(F.when(F.col("_k").isNull(), 1).otherwise(0)).alias("dropped"))


def kg_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (kind, name, value): nodes by type, edges by relation, degree quantiles, isolated nodes."""
    by_type = nodes.groupBy("ntype").agg(F.count("*").cast("double").alias("value")).select(F.lit("nodes").alias("kind"), F.col("ntype").alias("name"), "value")
    by_rel = edges.groupBy("rel").agg(F.count("*").cast("double").alias("value")).select(F.lit("edges"), "rel", "value")
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    degree = cut(ends.groupBy("node").agg(F.count("*").alias("d")))
    label = F.create_map(*[F.lit(v) for q, n in ((0.5, "p50"), (0.9, "p90"), (1.0, "p100")) for v in (q, n)])
    qs = exact_quantiles(degree, "d", [0.5, 0.9, 1.0], []).select(F.lit("degree"), label[F.col("q")], "value")
    alone = nodes.join(degree, "node", "left_anti").agg(F.count("*").cast("double").alias("value")).select(F.lit("isolated"), F.lit("nodes"), "value")
    return by_type.union(by_rel).union(qs).union(alone)
