"""Registered queries: knowledge graph and exposure, with loops unrolled in the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.functions.lineage import cut
from ripplemark.functions.numeric import quantised, rounded
from ripplemark.operators import exposure as gx
from ripplemark.operators import kg
from ripplemark.plans import fixtures as fx
from ripplemark.plans.fixtures import VIEWS, sql

HOPS, STEPS, PIVOT_HOPS = 4, 15, 6
TOL, MOST = 1e-3, 50  # on this graph the change of a step is 2 * 0.85 ** k, below TOL from step 47 on; it is measured every 5 steps
Q: dict[str, tuple] = {}


def q(x: str) -> str:
    return f"floor(({x}) * 1000000 + 0.5) / 1000000"


def query(name: str, oracle: str | None = None):
    def add(f):
        Q[name] = (f, oracle)
        return f

    return add


def loop(body: str, needs: tuple[str, ...], steps: list[tuple[str, str]]) -> str:
    """A query whose views `needs` are followed by the steps' own tables."""
    head = sql("", *needs).rstrip()
    return head + "".join(f", {n} AS MATERIALIZED ({x})" for n, x in steps) + " " + body


def edges(s: SparkSession, d: str) -> DataFrame:
    return kg.kg_edges(fx.seed_edges(s, d))


def graph(s: SparkSession, d: str) -> DataFrame:
    """Symmetric edges with transition probabilities, written once since loops read them at every step."""
    return cut(kg.transition(kg.symmetrise(edges(s, d))))


def nation_seeds(s: SparkSession, d: str) -> DataFrame:
    n = F.concat(F.lit("N"), F.col("n_nationkey"))
    return fx.table(s, d, "nation").select(n.alias("event_id"), n.alias("node"), F.lit(1.0).alias("w"))


def region_pivots(s: SparkSession, d: str) -> DataFrame:
    return fx.table(s, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("node"))


@query("kg_edges", sql(f"SELECT src, dst, rel, {q('w')} AS w FROM edges", "edges"))
def _(s, d):
    return rounded(edges(s, d), "w")


@query("kg_nodes", sql("SELECT node, CASE left(node, 1) WHEN 'S' THEN 'company' WHEN 'N' THEN 'nation' WHEN 'R' THEN 'region' WHEN 'B' THEN 'brand' ELSE 'customer' END AS ntype FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges UNION SELECT 'S' || s_suppkey FROM supplier)", "edges"))
def _(s, d):
    u = fx.universe(s, d).select(F.concat(F.lit("S"), "ent").alias("node"), F.lit("company").alias("ntype"))
    return kg.kg_nodes(edges(s, d), u)


@query("kg_symmetrise", sql(f"SELECT src, dst, {q('w')} AS w FROM sym", "sym"))
def _(s, d):
    return rounded(kg.symmetrise(edges(s, d)), "w")


@query("kg_transition", sql(f"SELECT src, dst, {q('p')} AS p FROM trans", "trans"))
def _(s, d):
    return rounded(kg.transition(kg.symmetrise(edges(s, d))), "p").select("src", "dst", "p")


@query("kg_build", sql(f"SELECT 'edges' AS part, count(*) AS n, {q('sum(p)')} AS total FROM trans UNION ALL SELECT 'nodes', count(*), NULL FROM (SELECT src FROM edges UNION SELECT dst FROM edges)", "trans", "edges"))
def _(s, d):
    nodes, e = kg.build_kg(fx.seed_edges(s, d))
    return rounded(e.agg(F.count("*").alias("n"), F.sum("p").alias("total")).select(F.lit("edges").alias("part"), "n", "total"), "total").union(nodes.agg(F.count("*").alias("n")).select(F.lit("nodes"), "n", F.lit(None).cast("double")))


@query("kg_seed_vector", sql(f"SELECT country AS event_id, 'S' || ent AS node, {q('1.0 / count(*) OVER (PARTITION BY country)')} AS w FROM universe", "universe"))
def _(s, d):
    tags = fx.universe(s, d).select(F.col("country").alias("event_id"), F.concat(F.lit("S"), "ent").alias("node"), F.lit(2.0).alias("w"))
    tags = tags.union(tags.select("event_id", F.lit("nowhere"), F.lit(1.0)).distinct())
    return rounded(kg.seed_vector(tags, kg.kg_nodes(edges(s, d)))[0], "w").select("event_id", "node", "w")


DEGREES = "SELECT node, count(*) AS d FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1"


@query("kg_stats", sql(f"SELECT 'nodes' AS kind, CASE left(node, 1) WHEN 'S' THEN 'supplier' WHEN 'N' THEN 'nation' WHEN 'R' THEN 'region' WHEN 'B' THEN 'brand' ELSE 'customer' END AS name, CAST(count(*) AS DOUBLE) AS value FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) GROUP BY 2 UNION ALL SELECT 'edges', rel, CAST(count(*) AS DOUBLE) FROM edges GROUP BY 2 UNION ALL SELECT 'degree', unnest(['p50', 'p90', 'p100']), unnest(quantile_cont(CAST(d AS DOUBLE), [0.5, 0.9, 1.0])) FROM ({DEGREES}) UNION ALL SELECT 'isolated', 'nodes', CAST(0 AS DOUBLE)", "edges"))
def _(s, d):
    e = edges(s, d)
    return rounded(kg.kg_stats(kg.kg_nodes(e), e), "value")


BFS = [("h0", "SELECT event_id, node, 0 AS hops FROM seeds")] + [
    (f"h{k}", f"SELECT * FROM h{k - 1} UNION ALL SELECT DISTINCT f.event_id, e.dst, {k} FROM h{k - 1} f JOIN sym e ON e.src = f.node WHERE f.hops = {k - 1} AND NOT EXISTS (SELECT 1 FROM h{k - 1} g WHERE g.event_id = f.event_id AND g.node = e.dst)")
    for k in range(1, HOPS + 1)
]


def hops(s: SparkSession, d: str) -> DataFrame:
    return gx.hop_distance(graph(s, d), nation_seeds(s, d), HOPS)


@query("gx_hop_distance", loop(f"SELECT * FROM h{HOPS}", ("sym", "seeds"), BFS))
def _(s, d):
    return hops(s, d)


COSTS = [("c0", "SELECT event_id, node, CAST(0 AS DOUBLE) AS cost FROM seeds")] + [
    (f"c{k}", f"SELECT event_id, node, min(cost) AS cost FROM (SELECT * FROM c{k - 1} UNION ALL SELECT c.event_id, e.dst, c.cost - ln(e.w) FROM c{k - 1} c JOIN sym e ON e.src = c.node) GROUP BY 1, 2") for k in range(1, HOPS + 1)
]


@query("gx_weighted_distance", loop(f"SELECT event_id, node, {q('cost')} AS cost FROM c{HOPS}", ("sym", "seeds"), COSTS))
def _(s, d):
    return rounded(gx.weighted_distance(graph(s, d), nation_seeds(s, d), HOPS), "cost")


PATHS = [("p0", "SELECT event_id, node, 0 AS hops, node AS path FROM seeds")] + [
    (f"p{k}", f"SELECT h.event_id, h.node, {k} AS hops, arg_min(p.path, p.node) || '>' || h.node AS path FROM h{HOPS} h JOIN sym e ON e.dst = h.node JOIN p{k - 1} p ON p.event_id = h.event_id AND p.node = e.src WHERE h.hops = {k} GROUP BY 1, 2") for k in range(1, HOPS + 1)
]


@query("gx_shortest_path", loop(" UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(HOPS + 1)), ("sym", "seeds"), BFS + PATHS))
def _(s, d):
    g = graph(s, d)
    return gx.shortest_path(gx.hop_distance(g, nation_seeds(s, d), HOPS), g, HOPS).withColumn("path", F.array_join("path", ">"))


@query("gx_distance_exposure", loop(f"SELECT event_id, node, {q('pow(0.5, hops)')} AS score FROM h{HOPS}", ("sym", "seeds"), BFS))
def _(s, d):
    return rounded(gx.distance_exposure(hops(s, d)), "score")


@query("gx_cost_exposure", loop(f"SELECT event_id, node, floor(exp(-({q('cost')})) * 1000000000 + 0.5) / 1000000000 AS score FROM c{HOPS}", ("sym", "seeds"), COSTS))
def _(s, d):
    return gx.distance_exposure(rounded(gx.weighted_distance(graph(s, d), nation_seeds(s, d), HOPS), "cost"), by="cost").withColumn("score", quantised(F.col("score"), 9))


WALK = [("r0", "SELECT event_id, node, w AS score FROM seeds")] + [
    (f"r{k}", f"SELECT event_id, node, sum(score) AS score FROM (SELECT r.event_id, t.dst AS node, 0.85 * r.score * t.p AS score FROM r{k - 1} r JOIN trans t ON t.src = r.node UNION ALL SELECT event_id, node, 0.15 * w FROM seeds) GROUP BY 1, 2") for k in range(1, STEPS + 1)
]


def walk(s: SparkSession, d: str) -> DataFrame:
    return gx.rwr(graph(s, d), nation_seeds(s, d), 0.15, STEPS)


@query("gx_rwr", loop(f"SELECT event_id, node, {q('score')} AS score FROM r{STEPS}", ("trans", "seeds"), WALK))
def _(s, d):
    return rounded(walk(s, d), "score")


FULL = WALK + [(f"r{k}", WALK[-1][1].replace(f"r{STEPS - 1} r", f"r{k - 1} r")) for k in range(STEPS + 1, MOST + 1)]


@query("gx_rwr_converged", loop(f"SELECT event_id, node, {q('score')} AS score FROM r{MOST}", ("trans", "seeds"), FULL))
def _(s, d):
    return rounded(gx.rwr(graph(s, d), nation_seeds(s, d), 0.15, 10 * MOST, tol=TOL), "score")


EPS = 1e-2


@query("gx_forward_push")  # no SQL: which pairs move hangs on sums of floating-point numbers; tests hold it within EPS of the settled walk
def _(s, d):
    return rounded(gx.forward_push(graph(s, d), nation_seeds(s, d), 0.15, EPS), "score")


@query("gx_degree_centrality", sql(f"SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS degree, {q('sum(w)')} AS weighted, {q('sum(i + o) / CAST(count(*) OVER () - 1 AS DOUBLE)')} AS normalised FROM (SELECT src AS node, 0 AS i, 1 AS o, w FROM edges UNION ALL SELECT dst, 1, 0, w FROM edges) GROUP BY node", "edges"))
def _(s, d):
    return rounded(gx.degree_centrality(cut(edges(s, d))), "weighted", "normalised")


RANK = [("n1", "SELECT node, 1.0 / count(*) OVER () AS w FROM nodes"), ("k0", "SELECT node, w AS score FROM n1")] + [
    (f"k{k}", f"SELECT node, sum(score) AS score FROM (SELECT t.dst AS node, 0.85 * r.score * t.p AS score FROM k{k - 1} r JOIN trans t ON t.src = r.node UNION ALL SELECT node, 0.15 * w FROM n1) GROUP BY 1") for k in range(1, STEPS + 1)
]


@query("gx_pagerank", loop(f"SELECT node, floor(score * 1000000000 + 0.5) / 1000000000 AS score FROM k{STEPS}", ("trans", "nodes"), RANK))
def _(s, d):
    return gx.pagerank(graph(s, d), 0.85, STEPS).select("node", quantised(F.col("score"), 9).alias("score"))


PIVOT = [("h0", "SELECT 'R' || r_regionkey AS event_id, 'R' || r_regionkey AS node, 0 AS hops FROM region")] + [
    (f"h{k}", f"SELECT * FROM h{k - 1} UNION ALL SELECT DISTINCT f.event_id, e.dst, {k} FROM h{k - 1} f JOIN sym e ON e.src = f.node WHERE f.hops = {k - 1} AND NOT EXISTS (SELECT 1 FROM h{k - 1} g WHERE g.event_id = f.event_id AND g.node = e.dst)")
    for k in range(1, PIVOT_HOPS + 1)
]


@query("gx_closeness", loop(f"SELECT n.node, {q('''coalesce(sum(CASE WHEN h.hops > 0 THEN 1.0 / h.hops END), 0) / (5 - max(CASE WHEN n.node LIKE 'R%' THEN 1 ELSE 0 END))''')} AS closeness FROM nodes n LEFT JOIN h{PIVOT_HOPS} h ON h.node = n.node GROUP BY 1", ("sym", "nodes"), PIVOT))
def _(s, d):
    return rounded(gx.closeness(graph(s, d), region_pivots(s, d), PIVOT_HOPS), "closeness")


@query("gx_closeness_all")  # no SQL: sketches; tests hold it within 5 % of the exact values
def _(s, d):
    return rounded(gx.closeness_sketched(kg.symmetrise(edges(s, d)), PIVOT_HOPS), "closeness")


BETWEEN = [("s0", "SELECT event_id, node, CAST(1 AS DOUBLE) AS sigma FROM h0")] + [
    (f"s{k}", f"SELECT h.event_id, h.node, sum(s.sigma) AS sigma FROM h{PIVOT_HOPS} h JOIN sym e ON e.dst = h.node JOIN s{k - 1} s ON s.event_id = h.event_id AND s.node = e.src WHERE h.hops = {k} GROUP BY 1, 2") for k in range(1, PIVOT_HOPS + 1)
]
BETWEEN += [(f"d{PIVOT_HOPS}", f"SELECT event_id, node, sigma, CAST(0 AS DOUBLE) AS delta FROM s{PIVOT_HOPS}")] + [
    (f"d{k}", f"SELECT s.event_id, s.node, s.sigma, coalesce(sum(s.sigma / b.sigma * (1 + b.delta)), 0) AS delta FROM s{k} s LEFT JOIN sym e ON e.src = s.node LEFT JOIN d{k + 1} b ON b.event_id = s.event_id AND b.node = e.dst GROUP BY 1, 2, 3") for k in range(PIVOT_HOPS - 1, 0, -1)
]


@query("gx_betweenness", loop(f"SELECT n.node, {q('coalesce(sum(x.delta), 0) * 0.5 * (SELECT count(*) FROM nodes) / 5.0')} AS betweenness FROM nodes n LEFT JOIN ({' UNION ALL '.join(f'SELECT node, delta FROM d{k}' for k in range(1, PIVOT_HOPS + 1))}) x ON x.node = n.node GROUP BY 1", ("sym", "nodes"), PIVOT + BETWEEN))
def _(s, d):
    return rounded(gx.betweenness(graph(s, d), region_pivots(s, d), PIVOT_HOPS, symmetric=True), "betweenness")


@query("gx_betweenness_sampled")  # no SQL: random draws; tests hold it within its bound of the exact values
def _(s, d):
    return rounded(gx.betweenness_sampled(kg.symmetrise(edges(s, d)), 0.1, 0.1), "betweenness")


EIGEN = [("x0", "SELECT node, 1 / sqrt(count(*) OVER ()) AS x FROM nodes")] + [
    (f"x{k}", f"SELECT node, x / sqrt(sum(x * x) OVER ()) AS x FROM (SELECT node, sum(x) AS x FROM (SELECT e.dst AS node, x.x * e.w AS x FROM x{k - 1} x JOIN sym e ON e.src = x.node UNION ALL SELECT node, x FROM x{k - 1}) GROUP BY 1)") for k in range(1, STEPS + 1)
]


@query("gx_eigenvector", loop(f"SELECT node, {q('x')} AS score FROM x{STEPS}", ("sym", "nodes"), EIGEN))
def _(s, d):
    return rounded(gx.eigenvector(graph(s, d), STEPS), "score")


@query("gx_rank_exposure", loop(f"SELECT event_id, node, score, rnk, {q('pct')} AS pct, {q('scaled')} AS scaled FROM (SELECT *, dense_rank() OVER (PARTITION BY event_id ORDER BY score DESC) AS rnk, percent_rank() OVER (PARTITION BY event_id ORDER BY score DESC) AS pct, (score - min(score) OVER (PARTITION BY event_id)) / (max(score) OVER (PARTITION BY event_id) - min(score) OVER (PARTITION BY event_id)) AS scaled, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, node) AS r FROM (SELECT event_id, node, {q('score')} AS score FROM r{STEPS})) WHERE r <= 10", ("trans", "seeds"), WALK))
def _(s, d):
    return rounded(gx.rank_exposure(rounded(walk(s, d), "score").withColumn("measure", F.lit("rwr")), 10), "pct", "scaled").drop("measure")


@query("gx_exposure_baseline", loop(f"SELECT coalesce(r.event_id, h.event_id) AS event_id, coalesce(r.node, h.node) AS node, coalesce({q('r.score')}, 0) AS rwr, coalesce({q('pow(0.5, h.hops)')}, 0) AS hops FROM r{STEPS} r FULL OUTER JOIN h{HOPS} h ON h.event_id = r.event_id AND h.node = r.node", ("trans", "seeds"), BFS + WALK))
def _(s, d):
    both = walk(s, d).withColumn("measure", F.lit("rwr")).unionByName(gx.distance_exposure(hops(s, d)).withColumn("measure", F.lit("hops")))
    return gx.exposure_baseline(rounded(both, "score"), ["rwr", "hops"])


COMPONENTS = [("m0", "SELECT node, node AS component FROM nodes")] + [
    (f"m{k}", f"SELECT node, min(component) AS component FROM (SELECT * FROM m{k - 1} UNION ALL SELECT e.dst, m.component FROM m{k - 1} m JOIN sym e ON e.src = m.node) GROUP BY 1") for k in range(1, 17)
]


@query("x_components", loop("SELECT * FROM m16", ("sym", "nodes"), COMPONENTS))
def _(s, d):
    return gx.connected_components(graph(s, d))


@query("x_rank_agreement", loop(f"SELECT event_id, count(*) AS n, {q('corr(a, b)')} AS agreement FROM (SELECT event_id, rank() OVER (PARTITION BY event_id ORDER BY rwr) + (count(*) OVER (PARTITION BY event_id, rwr) - 1) / 2.0 AS a, rank() OVER (PARTITION BY event_id ORDER BY hops) + (count(*) OVER (PARTITION BY event_id, hops) - 1) / 2.0 AS b FROM (SELECT r.event_id, {q('r.score')} AS rwr, {q('pow(0.5, h.hops)')} AS hops FROM r{STEPS} r JOIN h{HOPS} h ON h.event_id = r.event_id AND h.node = r.node)) GROUP BY 1", ("trans", "seeds"), BFS + WALK))
def _(s, d):
    return rounded(gx.rank_agreement(rounded(walk(s, d), "score"), rounded(gx.distance_exposure(hops(s, d)), "score")), "agreement")
