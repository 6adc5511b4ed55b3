"""Exposure over the graph: distances, random walks, centralities.

Loops are steps of (event, node) rows along the edges, and written tables cut
their lineage.  A small edge table is broadcast; in a larger one the edges of
nodes that have very many are cut into parts, and what stands at such a node is
copied to each part.  Leaves of one node go through the loops as one lump, and
get rows of their own at the end.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, floor, log, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.functions.hubs import Edges, parted
from ripplemark.functions.lineage import cut
from ripplemark.functions.lumps import lumped
from ripplemark.functions.numeric import mid_rank
from ripplemark.functions.ranking import few, positions, ranked_values

#: Nodes that at least so many have edges to send their sketches to all tasks, so many of them at most.
SENDERS = (1000, 2000)


def hop_distance(edges: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """(event_id, node, hops): least hops from any of an event's seeds(event_id, node); unreached nodes are absent."""
    lumps = lumped(cut(edges.select("src", "dst").distinct()), seeds)
    return lumps.spread(_hops(lumps.edges, seeds, max_hops))


def _hops(edges: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """hop_distance() along written edges(src, dst) that are distinct."""
    e = parted(edges)
    seen = cut(seeds.select("event_id", "node").distinct().withColumn("hops", F.lit(0)))
    front = seen
    for k in range(1, max_hops + 1):
        step = e.step(front.select("event_id", "node")).select("event_id", F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, ["event_id", "node"], "left_anti").withColumn("hops", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def weighted_distance(edges: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """(event_id, node, cost): least sum of -ln(w) over paths of at most max_hops edges.

    A turn goes on only from the pairs that the turn before made cheaper, and
    writes only those that it makes cheaper; the least of all is a pair's cost.
    """
    e = parted(edges.select("src", "dst", (-F.log("w")).alias("c")))
    front = cut(seeds.select("event_id", "node").distinct().withColumn("cost", F.lit(0.0)))
    dist = front
    for _ in range(max_hops):
        step = e.step(front).select("event_id", F.col("dst").alias("node"), F.lit(None).cast("double").alias("old"), (F.col("cost") + F.col("c")).alias("new"))
        known = dist.select("event_id", "node", F.col("cost").alias("old"), F.lit(None).cast("double").alias("new"))
        both = known.union(step).groupBy("event_id", "node").agg(F.min("old").alias("old"), F.min("new").alias("cost"))
        front = cut(both.filter("cost IS NOT NULL AND (old IS NULL OR cost < old)").select("event_id", "node", "cost"))
        if front.isEmpty():
            break
        dist = dist.unionByName(front)
    return dist.groupBy("event_id", "node").agg(F.min("cost").alias("cost"))


def shortest_path(hops: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """One path per (event_id, node) as an array from seed to node; of several predecessors the least id.

    A leaf's path is that of its node and the leaf, so leaves get theirs at the
    end, from their lump's: only the hops of one leaf of each are read before.
    """
    lumps = lumped(cut(edges.select("src", "dst").distinct()), hops.filter("hops = 0"))
    if lumps.members is not None:
        others = few(cut(lumps.members.filter("node <> lump").select(F.col("node").alias("_l"))))
        hops = hops.join(others, F.col("node") == F.col("_l"), "left_anti")
    hops = cut(hops)
    e = parted(lumps.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))  # from a node to those before it
    paths = hops.filter("hops = 0").select("event_id", "node", "hops", F.array("node").alias("path"))
    done = paths
    for k in range(1, max_hops + 1):
        at = hops.filter(F.col("hops") == k).select("event_id", "node", "hops")
        step = e.step(at).select("event_id", "node", "hops", F.col("dst").alias("before")).join(paths.select("event_id", F.col("node").alias("before")), ["event_id", "before"], "left_semi")
        least = step.groupBy("event_id", "node", "hops").agg(F.min("before").alias("before"))
        paths = cut(least.join(paths.select("event_id", F.col("node").alias("before"), "path"), ["event_id", "before"]).select("event_id", "node", "hops", F.concat("path", F.array("node")).alias("path")))
        done = done.unionByName(paths)
    if lumps.members is None:
        return done
    return lumps.spread(done).withColumn("path", F.when(F.col("hops") > 0, F.concat(F.slice("path", F.lit(1), F.col("hops")), F.array("node"))).otherwise(F.col("path")))


def distance_exposure(dist: DataFrame, lam: float = 0.5, by: str = "hops") -> DataFrame:
    """lam ** hops, or exp(-cost); the greatest of several."""
    score = F.pow(F.lit(lam), F.col("hops")) if by == "hops" else F.exp(-F.col("cost"))
    return dist.groupBy("event_id", "node").agg(F.max(score).alias("score"))


def dead_ends(p: DataFrame, seeds: DataFrame) -> DataFrame:
    """The nodes that a walk can reach but not leave."""
    return seeds.select("node").union(p.select("dst")).distinct().join(p.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def rwr(p: DataFrame, seeds: DataFrame, c: float = 0.15, iters: int = 15, every: int = 5, tol: float | None = None) -> DataFrame:
    """Random walk with restart for all events at once: r <- (1 - c) P'r + c e; mass at dead ends returns to e.

    seeds(event_id, node, w) sum to 1 by event.  One aggregation a step; the
    restart term joins as rows, and a checkpoint every few steps cuts the lineage.
    With `tol`, these steps also measure by how much any event's scores change in
    a step, summed over nodes, and stop below it; `iters` is then the most.
    """
    lumps = lumped(p.select("src", "dst", "p"), seeds, same=("p",))
    return lumps.spread(_walk(lumps.edges, seeds, c, iters, every, tol), "score")


def _walk(p: DataFrame, seeds: DataFrame, c: float, iters: int, every: int = 5, tol: float | None = None) -> DataFrame:
    """rwr() with a row for each event and node that mass reaches at every step."""
    e = parted(p.select("src", "dst", "p"))
    restart = seeds.select("event_id", "node", "w")
    dead = cut(dead_ends(p, seeds))
    has_dead = dead.limit(1).count() > 0
    r, before = restart.select("event_id", "node", F.col("w").alias("score")), None
    for i in range(iters):
        moved = e.step(r).select("event_id", F.col("dst").alias("node"), ((1 - c) * F.col("score") * F.col("p")).alias("score"))
        parts = moved.union(restart.select("event_id", "node", c * F.col("w")))
        if has_dead:
            lost = r.join(dead, "node").groupBy("event_id").agg(((1 - c) * F.sum("score")).alias("lost"))
            parts = parts.union(restart.join(lost, "event_id").select("event_id", "node", F.col("w") * F.col("lost")))
        r = parts.groupBy("event_id", "node").agg(F.sum("score").alias("score"))
        if tol is not None and (i + 2) % every == 0:
            before = r = cut(r)
        if (i + 1) % every == 0 or i + 1 == iters:
            r = cut(r)
            if tol is not None and before is not None:
                both = r.unionByName(before.withColumn("score", -F.col("score"))).groupBy("event_id", "node").agg(F.sum("score").alias("d"))
                if (both.groupBy("event_id").agg(F.sum(F.abs("d")).alias("d")).agg(F.max("d")).first()[0] or 0.0) < tol:
                    break
    return r


def forward_push(p: DataFrame, seeds: DataFrame, c: float = 0.15, eps: float = 1e-3, every: int = 2) -> DataFrame:
    """(event_id, node, score): the walk's scores by forward push, with only the pairs that mass reaches.

    A pair's residual is mass that has arrived and not moved yet.  Where it is
    over eps times the node's share of the greatest weighted degree, it moves: c
    of it stays as score, the rest goes along the edges (from a dead end: back
    to the seeds); a turn moves all such pairs, and joins no others with edges.
    On symmetric edges a score falls short of the settled walk's by less than
    eps times that share, so by less than eps.  p(src, dst, w, p).  Leaves of a
    node have residuals by their weights, so a lump of them moves when each would.
    """
    most = p.groupBy("src").agg(F.sum("w").alias("_w")).agg(F.max("_w")).first()[0] or 1.0
    lumps = lumped(p.select("src", "dst", "w", "p"), seeds, same=("p",), sums=("w",))
    p = lumps.edges
    e = parted(p.select("src", "dst", "p"))
    restart = seeds.groupBy("event_id", "node").agg(F.sum("w").alias("w"))
    weight = p.groupBy(F.col("src").alias("_n")).agg(F.sum("w").alias("_w"))
    least = few(cut(weight.select("_n", (eps * F.col("_w") / most).alias("least"))))
    dead = cut(dead_ends(p, seeds))
    has_dead = dead.limit(1).count() > 0
    state = cut(restart.select("event_id", "node", F.lit(0.0).alias("score"), F.col("w").alias("rest")).join(least, F.col("node") == F.col("_n"), "left").drop("_n"))
    while not state.filter(F.col("rest") > F.coalesce("least", F.lit(eps))).isEmpty():
        for _ in range(every):
            moves = F.col("rest") > F.coalesce("least", F.lit(eps))
            going = state.filter(moves)
            stay = state.select("event_id", "node", (F.col("score") + F.when(moves, c * F.col("rest")).otherwise(0.0)).alias("score"), F.when(moves, 0.0).otherwise(F.col("rest")).alias("rest"))
            parts = stay.unionByName(e.step(going).select("event_id", F.col("dst").alias("node"), F.lit(0.0).alias("score"), ((1 - c) * F.col("rest") * F.col("p")).alias("rest")))
            if has_dead:
                lost = going.join(dead, "node").groupBy("event_id").agg(((1 - c) * F.sum("rest")).alias("lost"))
                parts = parts.unionByName(restart.join(lost, "event_id").select("event_id", "node", F.lit(0.0).alias("score"), (F.col("w") * F.col("lost")).alias("rest")))
            state = parts.groupBy("event_id", "node").agg(F.sum("score").alias("score"), F.sum("rest").alias("rest"))
            state = state.join(least, F.col("node") == F.col("_n"), "left").drop("_n")
        state = cut(state)
    return lumps.spread(state.filter("score > 0").select("event_id", "node", "score"), "score")


def degree_centrality(edges: DataFrame) -> DataFrame:
    """In, out, total and weighted degree; total also by the number of other nodes."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), "w"), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), "w"))).alias("x")).select("x.*")
    both = cut(ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"), F.sum("w").alias("weighted")))
    n = both.count()
    return both.withColumn("normalised", F.col("degree") / (n - 1) if n > 1 else F.lit(None).cast("double"))


def pagerank(p: DataFrame, d: float = 0.85, iters: int = 15, tol: float | None = None) -> DataFrame:
    """r <- d P'r + (1 - d) / n, with the share of dead ends spread over all: a walk that restarts anywhere."""
    nodes = p.select(F.col("src").alias("node")).union(p.select("dst")).distinct()
    n = nodes.count()
    seeds = nodes.select(F.lit("all").alias("event_id"), "node", F.lit(1.0 / max(1, n)).alias("w"))
    return _walk(p, cut(seeds), 1 - d, iters, tol=tol).select("node", "score")


def closeness(edges: DataFrame, pivots: DataFrame, max_hops: int) -> DataFrame:
    """Harmonic: mean over the pivots(node) other than the node of 1 / distance, unreached ones counting 0."""
    own = pivots.select("node").distinct()
    n = own.count()
    dist = hop_distance(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), own.select(F.col("node").alias("event_id"), "node"), max_hops)
    by = dist.filter("hops > 0").groupBy("node").agg(F.sum(1.0 / F.col("hops")).alias("s"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    others = F.lit(n) - F.when(F.col("_p").isNotNull(), 1).otherwise(0)
    rows = nodes.join(by, "node", "left").join(own.withColumn("_p", F.lit(1)), "node", "left")
    return rows.select("node", F.when(others > 0, F.coalesce("s", F.lit(0.0)) / others).otherwise(0.0).alias("closeness"))


def closeness_sketched(edges: DataFrame, max_hops: int, lg_k: int = 12) -> DataFrame:
    """Harmonic closeness of all nodes: the mean of 1 / distance to the other nodes within max_hops, unreached ones counting 0.

    A node's sketch counts the distinct nodes within k hops; a turn unites a
    node's with those of the nodes it has edges to, so that all nodes are
    measured in max_hops turns.  A count is off by about 1.04 / 2 ** (lg_k / 2).

    A leaf has no sketch: within k hops of it is what is within k - 1 of its
    node.  Sketches of the nodes that very many have edges to are few, and go to
    all tasks; only those of other nodes go along edges.
    """
    e = cut(edges.select("src", "dst").distinct())
    nodes = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    n = nodes.count()
    lumps = lumped(e, nodes.limit(0))
    inner, leaves = nodes, None
    if lumps.members is not None:
        leaves = lumps.members.select("node", "at")
        inner = nodes.join(few(leaves.select(F.col("node").alias("_l"))), F.col("node") == F.col("_l"), "left_anti")
    ends = cut(lumps.rest.groupBy("dst").agg(F.count("*").alias("n")).filter(F.col("n") >= SENDERS[0]).orderBy(F.desc("n"), "dst").limit(SENDERS[1]))
    hubs = F.broadcast(ends.select(F.col("dst").alias("_hub")))
    pulled = cut(lumps.rest.join(hubs, F.col("dst") == F.col("_hub"), "left_semi"))
    back = parted(cut(lumps.rest.join(hubs, F.col("dst") == F.col("_hub"), "left_anti").select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    zero = {"size": F.lit(1.0), "sum": F.lit(0.0), "leaf": F.lit(1.0 if max_hops > 0 else 0.0)}
    now = cut(inner.groupBy("node").agg(F.hll_sketch_agg("node", lg_k).alias("s")).withColumns(zero))
    for k in range(1, max_hops + 1):
        state = now.select("node", "s")
        far = F.broadcast(state.join(hubs, F.col("node") == F.col("_hub")).select("_hub", "s"))
        got = [pulled.repartition("src").join(far, F.col("dst") == F.col("_hub")).groupBy("src").agg(F.hll_union_agg("s").alias("t")), back.step(state).groupBy("dst").agg(F.hll_union_agg("s").alias("t"))]
        if k == 1 and leaves is not None:
            got.append(leaves.groupBy("at").agg(F.hll_sketch_agg("node", lg_k).alias("t")))
        grown, t = now, F.col("s")
        for i, g in enumerate(got):
            grown = grown.join(g.toDF(f"_n{i}", f"_t{i}"), F.col("node") == F.col(f"_n{i}"), "left")
            t = F.hll_union(t, F.coalesce(f"_t{i}", "s"))
        grown = grown.select("node", t.alias("s"), "size", "sum", "leaf").withColumn("more", F.greatest(F.lit(0.0), F.hll_sketch_estimate("s") - F.col("size")))
        size = F.col("size") + F.col("more")
        later = F.lit(0.0) if k == max_hops else (F.greatest(F.lit(0.0), size - 2) if k == 1 else F.col("more")) / (k + 1)  # a leaf finds itself and its node before
        now = cut(grown.select("node", "s", size.alias("size"), (F.col("sum") + F.col("more") / k).alias("sum"), (F.col("leaf") + later).alias("leaf"), "more"))
        if now.filter("more > 0").isEmpty():
            break
        now = now.drop("more")
    sums = now.select("node", "sum")
    if leaves is not None:
        along = parted(leaves.select(F.col("at").alias("src"), F.col("node").alias("dst")))
        sums = sums.unionByName(along.step(now.select("node", "leaf")).select(F.col("dst").alias("node"), F.col("leaf").alias("sum")))
    return sums.select("node", (F.least(F.col("sum"), F.lit(float(max(0, n - 1)))) / max(1, n - 1)).alias("closeness"))


def _path_counts(e: DataFrame, starts: DataFrame, max_hops: int) -> list[DataFrame]:
    """For each distance from 0 on, two or more: (event_id, node, sigma), the number of shortest paths from the event's start, counted while nodes are found."""
    along = parted(e)
    front = cut(starts.select("event_id", "node", F.lit(1.0).alias("sigma")))
    levels, seen = [front], front.select("event_id", "node")
    for _ in range(max(1, max_hops)):
        step = along.step(front).groupBy("event_id", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))
        front = cut(step.join(seen, ["event_id", "node"], "left_anti"))
        if front.isEmpty() and len(levels) > 1:
            break
        levels.append(front)
        seen = seen.unionByName(front.select("event_id", "node"))
    return levels


def _paths_between(e: DataFrame, ends: DataFrame) -> tuple[list[DataFrame], DataFrame, Edges]:
    """Path counts by distance as _path_counts() gives, from each event's `from` until a node with an edge to `to` is found; (event_id, node, steps) of the targets reached; and the edges turned round.

    e(src, dst) is written and distinct, ends(event_id, from, to) of different nodes.
    """
    along, back = parted(e), parted(cut(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    goal = cut(back.step(ends.select("event_id", F.col("to").alias("node"))).select("event_id", F.col("dst").alias("node"), F.col("node").alias("to")))
    front = cut(ends.select("event_id", F.col("from").alias("node"), F.lit(1.0).alias("sigma")))
    levels, seen, reached = [], front.select("event_id", "node"), []
    while not front.isEmpty():
        levels.append(front)
        there = front.join(goal, ["event_id", "node"]).select("event_id", F.col("to").alias("node")).distinct()
        reached.append(cut(there.withColumn("steps", F.lit(len(levels)))))
        going = front.join(few(reached[-1]).select("event_id"), "event_id", "left_anti")
        step = along.step(going).groupBy("event_id", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))
        front = cut(step.join(seen, ["event_id", "node"], "left_anti"))
        seen = seen.unionByName(front.select("event_id", "node"))
    none = ends.select("event_id", F.col("to").alias("node"), F.lit(0).alias("steps")).limit(0)
    return levels, reduce(lambda x, y: x.unionByName(y), reached, none), back


def betweenness(edges: DataFrame, pivots: DataFrame, max_hops: int, symmetric: bool = False, scaled: bool = True) -> DataFrame:
    """Dependency accumulation over shortest paths from the pivots: counts forward by level, then sums backward.

    On symmetric edges each path counts once, not in both directions; `scaled`
    multiplies what the pivots give by nodes / pivots, as an estimate for all.
    """
    e = cut(edges.select("src", "dst").distinct())
    starts = pivots.select(F.col("node").alias("event_id"), "node").distinct()
    levels = _path_counts(e, starts, max_hops)
    max_hops = len(levels) - 1
    below, sums = None, []
    for k in range(max_hops, 0, -1):
        delta = levels[k].withColumn("delta", F.lit(0.0))
        if below is not None:
            step = below.select("event_id", F.col("node").alias("dst"), F.col("sigma").alias("s2"), F.col("delta").alias("d2")).join(e, "dst").join(levels[k].select("event_id", F.col("node").alias("src"), "sigma"), ["event_id", "src"])
            got = step.groupBy("event_id", F.col("src").alias("node")).agg(F.sum(F.col("sigma") / F.col("s2") * (1 + F.col("d2"))).alias("got"))
            delta = levels[k].join(got, ["event_id", "node"], "left").select("event_id", "node", "sigma", F.coalesce("got", F.lit(0.0)).alias("delta"))
        below = cut(delta)
        sums.append(below.select("node", "delta"))
    total = sums[0]
    for s in sums[1:]:
        total = total.union(s)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    factor = (0.5 if symmetric else 1.0) * (nodes.count() / max(1, starts.count()) if scaled else 1.0)
    return nodes.join(total.groupBy("node").agg(F.sum("delta").alias("d")), "node", "left").select("node", (factor * F.coalesce("d", F.lit(0.0))).alias("betweenness"))


def path_samples(edges: DataFrame, eps: float, delta: float) -> int:
    """Shortest paths to draw so that, with a chance of 1 - delta, no node's share of paths is off by over eps.

    That number grows with the logarithm of the nodes on a longest shortest path
    of symmetric edges, which twice the farthest distance from one node of a
    component bounds; the greatest of all components counts.
    """
    e = edges.select("src", "dst").distinct()
    from_each = connected_components(e).select("component").distinct().select(F.col("component").alias("event_id"), F.col("component").alias("node"))
    far = hop_distance(e, from_each, 1 << 30).agg(F.max("hops")).first()[0] or 0
    longest = 2 * far + 1  # nodes on it
    return ceil(0.5 / eps**2 * (floor(log2(max(1, longest - 2))) + 1 + log(1 / delta)))


def betweenness_sampled(edges: DataFrame, eps: float = 0.05, delta: float = 0.1, seed: int = 1, samples: int | None = None) -> DataFrame:
    """(node, betweenness): the share of ordered pairs of nodes whose drawn shortest path has the node inside, for symmetric edges.

    Pairs are drawn at random, and for each one of its shortest paths, all alike
    likely: back from the target, a predecessor is taken as often as paths lead
    to it.  path_samples() sets the number of draws before the first one, so the
    error is at most eps for all nodes with a chance of 1 - delta.  A search goes
    between the nodes of leaves instead of leaves, and ends beside its target.
    """
    e = cut(edges.select("src", "dst").distinct())
    r = samples or path_samples(e, eps, delta)
    nodes = cut(positions(cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()), [], ["node"], "no"))
    n = nodes.count()
    if n < 2:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    draw = lambda k, m: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(m))
    pairs = e.sparkSession.range(r).select(F.col("id").cast("string").alias("event_id"), draw(1, n).alias("s"), draw(2, n - 1).alias("t"))
    pairs = pairs.withColumn("t", F.col("t") + (F.col("t") >= F.col("s")).cast("long"))  # another node than s
    pairs = pairs.join(nodes.withColumnsRenamed({"node": "a", "no": "s"}), "s").join(nodes.withColumnsRenamed({"node": "b", "no": "t"}), "t")
    pairs = pairs.select("event_id", "a", "b")
    lumps = lumped(e, nodes.limit(0))
    ends = pairs.withColumns({"from": F.col("a"), "to": F.col("b")})
    if lumps.members is not None:
        leaves = lumps.members.select(F.col("node").alias("_l"), "at")
        for c in ("from", "to"):
            ends = ends.join(leaves, F.col(c) == F.col("_l"), "left").withColumn(c, F.coalesce("at", c)).drop("_l", "at")
    ends = cut(ends)
    apart = ends.filter("from <> to")
    # the nodes that a path begins and ends at are inside it where leaves were drawn
    inner = [ends.select("event_id", "a", "b", F.explode(F.array_distinct(F.array("from", "to"))).alias("node")).filter("node <> a AND node <> b")]
    levels, reached, back = _paths_between(lumps.rest, apart)
    inner[0] = inner[0].join(reached.select("event_id").union(ends.filter("from = to").select("event_id")), "event_id", "left_semi").select("event_id", "node")
    at = None
    for k in range(len(levels) - 1, 0, -1):
        here = reached.filter(F.col("steps") == k + 1).select("event_id", "node")
        at = here if at is None else here.unionByName(at)
        before = back.step(at).select("event_id", F.col("dst").alias("node")).join(levels[k], ["event_id", "node"])
        luck = -F.log((F.pmod(F.xxhash64(F.lit(seed), F.lit(3), "event_id", "node"), F.lit(1 << 40)) + 0.5) / float(1 << 40)) / F.col("sigma")
        at = cut(before.groupBy("event_id").agg(F.min_by("node", luck).alias("node")))
        inner.append(at)
    hits = reduce(lambda x, y: x.unionByName(y), inner)
    share = hits.groupBy(F.col("node").alias("_n")).agg((F.count("*") / r).alias("share"))
    return nodes.join(share, F.col("node") == F.col("_n"), "left").select("node", F.coalesce("share", F.lit(0.0)).alias("betweenness"))


def eigenvector(edges: DataFrame, iters: int = 10) -> DataFrame:
    """Power iteration on A + I, scaled to length 1 at each step."""
    e = parted(edges.select("src", "dst", "w"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    n = nodes.count()
    x = cut(nodes.withColumn("x", F.lit(1.0 / max(1, n) ** 0.5)))
    for _ in range(iters):
        moved = e.step(x).select(F.col("dst").alias("node"), (F.col("x") * F.col("w")).alias("x"))
        y = moved.union(x.select("node", "x")).groupBy("node").agg(F.sum("x").alias("x"))
        norm = y.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_n"))
        x = cut(y.crossJoin(F.broadcast(norm)).select("node", (F.col("x") / F.col("_n")).alias("x")))
    return x.select("node", F.col("x").alias("score"))


def rank_exposure(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Per (event_id, measure): dense and percent rank, min-max scaled score, and if wanted the k first.

    Ranks are of distinct scores, and places of ranges of rows, so that an event
    that has scores of all nodes is no task of its own.
    """
    by = ["event_id", "measure"]
    rows = cut(scores)
    values = ranked_values(rows, by, "score", descending=True)
    if k is not None:
        values = values.filter(F.col("rnk") <= k)
    spread = few(cut(rows.groupBy(*[F.col(b).alias(f"_s{b}") for b in by]).agg(F.min("score").alias("low"), F.max("score").alias("high"))))
    values = cut(values.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("score").alias("_score"), "rnk", "dense", "total"))
    same = lambda mark, cols: reduce(lambda on, c: on & F.col(c).eqNullSafe(F.col(f"{mark}{c}")), cols, F.lit(True))
    both = rows.join(few(values), same("_", [*by, "score"])).join(spread, same("_s", by))
    pct = F.when(F.col("total") > 1, (F.col("rnk") - 1) / (F.col("total") - 1)).otherwise(0.0)
    scaled = F.when(F.col("high") > F.col("low"), (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    out = both.select(*[F.col(c) for c in scores.columns], F.col("dense").alias("rnk"), pct.alias("pct"), scaled.alias("scaled"))
    return out if k is None else positions(cut(out), by, [F.desc("score"), "node"], "_pos").filter(F.col("_pos") < k).drop("_pos")


def exposure_baseline(scores: DataFrame, measures: list[str]) -> DataFrame:
    """One row for each (event_id, node), a column for each measure, 0 where there is none."""
    return scores.groupBy("event_id", "node").pivot("measure", measures).agg(F.max("score")).na.fill(0.0, measures)


def rank_agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """(event_id, n, agreement): correlation of the mid-ranks of two scores(event_id, node, score) over the nodes that have both.

    A node's ranks hang on its two scores only, so nodes are counted by them
    before anything is ranked, and a pair of scores weighs as often as it occurs.
    """
    both = left.select("event_id", "node", F.col("score").alias("a")).join(right.select("event_id", "node", F.col("score").alias("b")), ["event_id", "node"])
    pairs = cut(both.groupBy("event_id", "a", "b").agg(F.count("*").alias("n")))
    rows = pairs
    for c in ("a", "b"):
        ranks = ranked_values(pairs, ["event_id"], c, rows="n").select(F.col("event_id").alias("_e"), F.col(c).alias("_v"), (mid_rank(F.col("rnk"), F.col("n")) - (F.col("total") + 1) / 2).alias(f"rank_{c}"))
        rows = rows.join(few(cut(ranks)), F.col("event_id").eqNullSafe(F.col("_e")) & F.col(c).eqNullSafe(F.col("_v"))).drop("_e", "_v")
    total = lambda x, y: F.sum(F.col("n") * F.col(x) * F.col(y))
    by = rows.groupBy("event_id").agg(F.sum("n").alias("n"), total("rank_a", "rank_b").alias("ab"), total("rank_a", "rank_a").alias("aa"), total("rank_b", "rank_b").alias("bb"))
    return by.select("event_id", "n", F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / (F.sqrt("aa") * F.sqrt("bb"))).alias("agreement"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node id reachable, however long the paths.

    A round links the neighbours of each node, first those above it and then it
    and those below it, to the least of them, until no edge changes; paths
    shorten by a constant factor a round.
    """
    nodes = cut(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    e, now = cut(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).filter("a <> b").distinct()), None
    while True:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        above = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = above.groupBy("a").agg(F.min("b").alias("m"))
        e = cut(above.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        before, now = now, e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
    return nodes.join(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
