"""Pushes, sketches, sampled paths, frontiers and hubs against exact answers on small graphs."""

from __future__ import annotations

import random
from collections import deque
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplemark.functions import hubs
from ripplemark.operators import exposure as gx
from ripplemark.operators import kg


def both_ways(pairs, rng=None):
    w = {p: (rng.choice([0.2, 0.5, 0.9]) if rng else 1.0) for p in pairs}
    return [(a, b, v) for (a, b), v in w.items()] + [(b, a, v) for (a, b), v in w.items()]


def tangle(n: int, extra: int, seed: int = 1) -> set:
    """A random tree with some more edges."""
    rng = random.Random(seed)
    pairs = {(f"n{rng.randrange(i)}", f"n{i}") for i in range(1, n)}
    while len(pairs) < n - 1 + extra:
        a, b = sorted(rng.sample(range(n), 2))
        pairs.add((f"n{a}", f"n{b}"))
    return pairs


def frame(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, w double")


def neighbours(rows):
    out: dict = {}
    for a, b, *_ in rows:
        out.setdefault(a, []).append(b)
    return out


def bfs(near, start):
    dist, count, queue = {start: 0}, {start: 1}, deque([start])
    while queue:
        u = queue.popleft()
        for v in near.get(u, ()):
            if v not in dist:
                dist[v], count[v] = dist[u] + 1, 0
                queue.append(v)
            if dist[v] == dist[u] + 1:
                count[v] += count[u]
    return dist, count


# ---- forward push


def settled(rows, seeds, c=0.15):
    """Scores of the walk by event, by power iteration until nothing changes."""
    nodes = sorted({x for a, b, _ in rows for x in (a, b)} | {v for _, v, _ in seeds})
    at, out = {v: i for i, v in enumerate(nodes)}, {}
    p = np.zeros((len(nodes), len(nodes)))
    for a, b, w in rows:
        p[at[a], at[b]] += w
    total = p.sum(axis=1, keepdims=True)
    p = np.divide(p, total, out=np.zeros_like(p), where=total > 0)
    for event in {e for e, *_ in seeds}:
        start = np.zeros(len(nodes))
        for e, v, w in seeds:
            start[at[v]] += w if e == event else 0
        r = start
        for _ in range(400):
            r = (1 - c) * (r @ p + r[total[:, 0] == 0].sum() * start) + c * start
        out |= {(event, v): r[i] for v, i in at.items()}
    return out


def test_push_is_within_eps_of_the_settled_walk_and_touches_few_pairs(spark):
    rows = both_ways({(f"p{i:03}", f"p{i + 1:03}") for i in range(150)} | tangle(40, 20), random.Random(2))
    seeds = [("a", "p000", 1.0), ("b", "p075", 0.5), ("b", "n3", 0.5), ("c", "n0", 0.25), ("c", "n0", 0.75)]
    exact, eps = settled(rows, seeds), 5e-3
    got = {(r.event_id, r.node): r.score for r in gx.forward_push(kg.transition(frame(spark, rows)), spark.createDataFrame(seeds, "event_id string, node string, w double"), 0.15, eps).collect()}
    assert all(-1e-9 < exact[k] - got.get(k, 0.0) < eps for k in exact)
    assert set(got) <= set(exact)
    assert len(got) < len(exact) / 2


def test_push_sends_mass_of_dead_ends_back(spark):
    rows, seeds = [("A", "B", 1.0), ("B", "C", 1.0)], [("e", "A", 1.0)]
    got = {("e", r.node): r.score for r in gx.forward_push(kg.transition(frame(spark, rows)), spark.createDataFrame(seeds, "event_id string, node string, w double"), 0.15, 0.01).collect()}
    assert got == pytest.approx(settled(rows, seeds), abs=0.02)


def test_push_without_rows(spark):
    none = spark.createDataFrame([], "src string, dst string, w double, p double")
    assert gx.forward_push(none, spark.createDataFrame([], "event_id string, node string, w double")).count() == 0
    alone = {r.node: r.score for r in gx.forward_push(none, spark.createDataFrame([("e", "A", 1.0)], "event_id string, node string, w double"), eps=0.1).collect()}
    assert alone == pytest.approx({"A": 1.0}, abs=0.1)


# ---- closeness


def test_sketched_closeness_of_all_nodes(spark):
    rows = both_ways(tangle(300, 100))
    near = neighbours(rows)
    exact = {v: sum(1 / d for d in bfs(near, v)[0].values() if d) / 299 for v in near}
    got = {r.node: r.closeness for r in gx.closeness_sketched(frame(spark, rows), 50, 12).collect()}
    assert set(got) == set(exact)
    errors = [abs(got[v] / exact[v] - 1) for v in exact]
    assert max(errors) < 0.05 and sum(errors) / len(errors) < 0.02


def test_sketched_closeness_keeps_directions_and_hops(spark):
    got = {r.node: r.closeness for r in gx.closeness_sketched(frame(spark, [("A", "B", 1.0), ("B", "C", 1.0), ("C", "D", 1.0)]), 2).collect()}
    assert got == pytest.approx({"A": 1.5 / 3, "B": 1.5 / 3, "C": 1 / 3, "D": 0.0}, abs=1e-3)


# ---- betweenness


def shares(near) -> dict:
    """The share of ordered pairs whose random shortest path has a node inside, exactly."""
    info = {v: bfs(near, v) for v in near}
    n, out = len(near), dict.fromkeys(near, 0.0)
    for s, (dist, count) in info.items():
        for t in dist:
            for v in dist:
                if t != s and v not in (s, t) and t in info[v][0] and dist[v] + info[v][0][t] == dist[t]:
                    out[v] += count[v] * info[v][1][t] / count[t]
    return {v: x / (n * (n - 1)) for v, x in out.items()}


def test_sampled_betweenness_is_within_its_bound(spark):
    rows = both_ways(tangle(60, 60) | {("x1", "x2"), ("x2", "x3")})
    near, e = neighbours(rows), frame(spark, rows)
    exact, drawn = shares(near), gx.path_samples(e, 0.1, 0.1)
    longest = 1 + max(max(bfs(near, v)[0].values()) for v in near)  # nodes on it
    assert drawn >= 50 * (int(log(longest - 2, 2)) + 1 + log(10))
    got = {r.node: r.betweenness for r in gx.betweenness_sampled(e, seed=1, samples=drawn).collect()}
    assert set(got) == set(exact)
    assert max(abs(got[v] - exact[v]) for v in exact) <= 0.1
    assert np.corrcoef([got[v] for v in exact], [exact[v] for v in exact])[0, 1] > 0.95


def test_sampled_betweenness_of_small_graphs(spark):
    assert gx.betweenness_sampled(frame(spark, []), samples=3).count() == 0
    path = {r.node: r.betweenness for r in gx.betweenness_sampled(frame(spark, both_ways({("A", "B"), ("B", "C")}))).collect()}
    assert path["A"] == path["C"] == 0 and path["B"] == pytest.approx(1 / 3, abs=0.06)


# ---- weighted distance


def test_weighted_distance_equals_relaxation_of_all_pairs(spark):
    rng = random.Random(7)
    rows = both_ways(tangle(30, 30), rng)
    seeds = [("a", "n0"), ("b", "n7"), ("b", "n9")]
    for hops in (1, 7):
        want = {(e, v): 0.0 for e, v in seeds}
        for _ in range(hops):
            step = dict(want)
            for (e, u), c in want.items():
                for a, b, w in rows:
                    if a == u:
                        step[e, b] = min(step.get((e, b), 1e9), c - log(w))
            want = step
        got = {(r.event_id, r.node): r.cost for r in gx.weighted_distance(frame(spark, rows), spark.createDataFrame(seeds, "event_id string, node string"), hops).collect()}
        assert got == pytest.approx(want)


# ---- hubs


def star(spark, leaves: int):
    ends = spark.range(leaves).select(F.lit("hub").alias("src"), F.concat(F.lit("v"), "id").alias("dst"), F.lit(1.0).alias("w"))
    return ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def test_a_star_is_cut_into_parts(spark):
    e = hubs.parted(star(spark, 100_000), degree=5000, small=1000)
    assert [(r.hub, r._parts) for r in e.hubs.collect()] == [("hub", 20)]
    sizes = sorted(r["count"] for r in e.rows.filter("src = 'hub'").groupBy("_part").count().collect())
    assert len(sizes) == 20 and sizes[-1] < 1.2 * sizes[10]
    state = spark.createDataFrame([("e", "hub"), ("e", "v5"), ("f", "hub")], "event_id string, node string")
    step = e.step(state)
    assert step.columns == ["event_id", "node", "src", "dst", "w"]
    assert {(r.event_id, r.node): r.n for r in step.groupBy("event_id", "node").agg(F.count("*").alias("n")).collect()} == {("e", "hub"): 100_000, ("f", "hub"): 100_000, ("e", "v5"): 1}


def test_measures_agree_with_and_without_parts(spark, monkeypatch):
    rng = random.Random(9)
    rows = both_ways(tangle(16, 10) | {("n1", f"leaf{i}") for i in range(60)}, rng)
    e, seeds = frame(spark, rows), spark.createDataFrame([("a", "n0", 1.0), ("b", "leaf3", 1.0)], "event_id string, node string, w double")
    p = kg.transition(e)
    measures = {
        "hops": lambda: gx.hop_distance(e, seeds, 2),
        "cost": lambda: gx.weighted_distance(e, seeds, 2),
        "walk": lambda: gx.rwr(p, seeds, 0.15, 3),
        "paths": lambda: gx.betweenness(e, spark.createDataFrame([("n0",)], "node string"), 3, symmetric=True),
        "eigen": lambda: gx.eigenvector(e, 2),
    }
    values = lambda df: {tuple(r[:-1]): r[-1] for r in df.collect()}
    plain = {k: values(f()) for k, f in measures.items()}
    whole = hubs.parted
    made = []

    def cut_small(edges, *a):
        made.append(whole(edges, degree=5, small=1))
        return made[-1]

    monkeypatch.setattr(gx, "parted", cut_small)
    for k, f in measures.items():
        assert values(f()) == pytest.approx(plain[k]), k
    assert all(m.hubs is not None for m in made)
