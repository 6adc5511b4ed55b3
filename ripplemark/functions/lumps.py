"""Leaves of a graph taken together, so that a loop carries one row for all that hang on a node."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.functions.hubs import parted
from ripplemark.functions.lineage import cut
from ripplemark.functions.ranking import few


@dataclass
class Lumps:
    """`rest`: the edges that touch no leaf; `edges`: these and the lumps' own; members(lump, node, at, share), None without leaves.

    A lump bears the name of one of its leaves.
    """

    edges: DataFrame
    rest: DataFrame
    members: DataFrame | None

    def spread(self, rows: DataFrame, *shared: str) -> DataFrame:
        """Each row of a lump as rows of its leaves, which have their share of the columns `shared` and the same of all others; rows is read twice."""
        if self.members is None:
            return rows
        names = few(cut(self.members.select(F.col("lump").alias("_lump")).distinct()))
        own = parted(self.members.select(F.col("lump").alias("src"), F.col("node").alias("dst"), "share")).step(rows)
        leaves = own.select(*[F.col("dst").alias(c) if c == "node" else (F.col(c) * F.col("share")).alias(c) if c in shared else F.col(c) for c in rows.columns])
        return rows.join(names, F.col("node") == F.col("_lump"), "left_anti").unionByName(leaves)


def lumped(edges: DataFrame, keep: DataFrame, same: tuple[str, ...] = (), sums: tuple[str, ...] = ()) -> Lumps:
    """Lumps the leaves of a node: nodes with one edge in and one out, both with that node, but for those in keep(node).

    All that reaches a leaf comes from its node, so the leaves of one node differ
    by their share of it only.  Edges to a lump have the sums of the columns
    `same` and `sums`, and shares go by the first of them; edges back have the
    sums of `sums`, and a lump's leaves are alike in `same`.  Of two nodes that
    have edges with each other only, the greater is the leaf.  Give written edges.
    """
    cols = [*same, *sums]
    none = lambda name: [F.lit(None).cast(edges.schema[c].dataType).alias(f"{name}{c}") for c in cols]
    some = lambda name: [F.col(c).alias(f"{name}{c}") for c in cols]
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("at"), F.lit(1).alias("_out"), F.lit(0).alias("_in"), *some("out_"), *none("in_"))
    ends = out.union(edges.select("dst", "src", F.lit(0), F.lit(1), *none("out_"), *some("in_")))
    by = ends.groupBy("node").agg(F.sum("_out").alias("_out"), F.sum("_in").alias("_in"), F.min("at").alias("at"), F.max("at").alias("_high"), *[F.max(f"{d}{c}").alias(f"{d}{c}") for d in ("out_", "in_") for c in cols])
    leaves = by.filter("_out = 1 AND _in = 1 AND at = _high AND at <> node").drop("_out", "_in", "_high")
    leaves = cut(leaves.join(keep.select("node").distinct(), "node", "left_anti"))
    leaves = leaves.join(leaves.select(F.col("node").alias("_l")), (F.col("at") == F.col("_l")) & (F.col("node") < F.col("at")), "left_anti")
    if leaves.isEmpty():
        return Lumps(edges, edges, None)
    keys = ["at", *[f"out_{c}" for c in same]]
    lumps = cut(leaves.groupBy(*keys).agg(F.min("node").alias("lump"), *[F.sum(f"in_{c}").alias(f"sum_in_{c}") for c in cols], *[F.sum(f"out_{c}").alias(f"sum_out_{c}") for c in sums]))
    names = few(lumps.select("lump", *[F.col(k).alias(f"_{k}") for k in keys], *[f"sum_in_{c}" for c in cols[:1]]))
    on = F.col("at") == F.col("_at")
    for c in same:
        on = on & F.col(f"out_{c}").eqNullSafe(F.col(f"_out_{c}"))
    share = F.when(F.col(f"sum_in_{cols[0]}") > 0, F.col(f"in_{cols[0]}") / F.col(f"sum_in_{cols[0]}")).otherwise(0.0) if cols else F.lit(1.0)
    members = cut(leaves.join(names, on).select("lump", "node", "at", share.alias("share")))
    gone = members.select(F.col("node").alias("_l"))
    rest = cut(edges.join(few(gone), F.col("src") == F.col("_l"), "left_anti").join(few(gone), F.col("dst") == F.col("_l"), "left_anti").select("src", "dst", *cols))
    there = lumps.select(F.col("at").alias("src"), F.col("lump").alias("dst"), *[F.col(f"sum_in_{c}").alias(c) for c in cols])
    back = lumps.select(F.col("lump").alias("src"), F.col("at").alias("dst"), *[F.col(f"out_{c}").alias(c) for c in same], *[F.col(f"sum_out_{c}").alias(c) for c in sums])
    return Lumps(cut(rest.unionByName(there).unionByName(back)), rest, members)
