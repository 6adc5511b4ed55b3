"""Leaves in lumps, agreement of ranks from counts, paths that stop at their target, distinct counts apart."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplemark.functions.lumps import Lumps, lumped
from ripplemark.operators import exposure as gx
from ripplemark.operators import kg
from ripplemark.operators import quality as qc

from .test_graph_at_scale import bfs, both_ways, frame, neighbours, shares, tangle


def bushy(rng=None) -> list:
    """A tangle whose nodes bear leaves, a pair apart and a star apart."""
    leaves = {(f"n{i % 7}", f"leaf{i:02}") for i in range(40)}
    return both_ways(tangle(15, 12) | leaves | {("x1", "x2")} | {("hub", f"y{i}") for i in range(5)}, rng)


def vector(spark, rows):
    return spark.createDataFrame(rows, "event_id string, node string, w double")


def values(df):
    return {tuple(r[:-1]): r[-1] for r in df.collect()}


def test_leaves_of_a_node_are_one_lump(spark):
    p = kg.transition(frame(spark, bushy(random.Random(3))))
    lumps = lumped(p.select("src", "dst", "w", "p"), vector(spark, [("e", "leaf03", 1.0)]), same=("p",), sums=("w",))
    members = lumps.members.collect()
    near = neighbours(bushy())
    leaves = {v for v, n in near.items() if len(n) == 1} - {"leaf03", "x1"}
    assert {r.node for r in members} == leaves
    assert all(near[r.node] == [r["at"]] for r in members)
    assert len({r.lump for r in members}) == len({r["at"] for r in members})
    assert lumps.edges.count() == lumps.rest.count() + 2 * len({r.lump for r in members})
    total = lambda df: df.agg(F.sum("p"), F.sum("w")).first()
    assert total(lumps.edges)[1] == pytest.approx(total(p)[1])
    assert {r.src: r.s for r in lumps.edges.groupBy("src").agg(F.sum("p").alias("s")).collect()} == pytest.approx({r.src: 1.0 for r in lumps.edges.select("src").distinct().collect()})


def test_walks_keep_no_row_of_a_leaf(spark, monkeypatch):
    p = kg.transition(frame(spark, bushy(random.Random(4)))).localCheckpoint()
    seeds = vector(spark, [("a", "n0", 1.0), ("b", "leaf03", 0.5), ("b", "n9", 0.5), ("c", "x2", 1.0)])
    whole, seen = gx._walk, []
    plain = values(whole(p, seeds, 0.15, 4))

    def spy(*a):
        seen.append(whole(*a))
        return seen[-1]

    monkeypatch.setattr(gx, "_walk", spy)
    got = values(gx.rwr(p, seeds, 0.15, 4))
    assert got == pytest.approx(plain, abs=1e-12)
    assert seen[0].filter("event_id = 'a'").count() <= 15 + 7 + 1 < sum(k[0] == "a" for k in got)


def test_hops_paths_and_pushes_with_leaves_equal_those_without(spark, monkeypatch):
    e = frame(spark, bushy(random.Random(5))).localCheckpoint()
    seeds = vector(spark, [("a", "n0", 1.0), ("b", "leaf03", 0.5), ("b", "n9", 0.5)])
    measures = {"hops": lambda: gx.hop_distance(e, seeds, 3), "path": lambda: gx.shortest_path(gx.hop_distance(e, seeds, 3), e, 3), "push": lambda: gx.forward_push(kg.transition(e), seeds, eps=0.05)}
    got = {k: values(f()) for k, f in measures.items()}
    monkeypatch.setattr(gx, "lumped", lambda edges, *a, **k: Lumps(edges, edges, None))
    for k, f in measures.items():
        assert got[k] == pytest.approx(values(f())) if k == "push" else got[k] == values(f()), k


def test_rank_agreement_counts_before_it_ranks(spark):
    rng = random.Random(6)
    rows = [(e, f"v{i}", rng.randrange(9) / 4, rng.randrange(4) / 2) for e in "ab" for i in range(60)] + [("c", "v1", 0.5, 1.0)]
    both = spark.createDataFrame(rows, "event_id string, node string, a double, b double")
    got = {r.event_id: (r.n, r.agreement) for r in gx.rank_agreement(both.select("event_id", "node", F.col("a").alias("score")), both.select("event_id", "node", F.col("b").alias("score"))).collect()}
    for e in "ab":
        a, b = ([r[i] for r in rows if r[0] == e] for i in (2, 3))
        rank = lambda x: [sum(y < v for y in x) + (x.count(v) + 1) / 2 for v in x]
        assert got[e] == (60, pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1]))
    assert got["c"] == (1, None)


def test_sketched_closeness_has_no_sketch_of_a_leaf(spark, monkeypatch):
    rows = bushy()
    near = neighbours(rows)
    monkeypatch.setattr(gx, "SENDERS", (6, 3))
    sizes, whole = [], gx.cut
    monkeypatch.setattr(gx, "cut", lambda df: sizes.append(whole(df)) or sizes[-1])
    for hops in (1, 3, 9):
        exact = {v: sum(1 / d for d in bfs(near, v)[0].values() if 0 < d <= hops) / (len(near) - 1) for v in near}
        assert values(gx.closeness_sketched(frame(spark, rows), hops)) == pytest.approx({(v,): x for v, x in exact.items()}, rel=0.02)
    assert max(t.count() for t in sizes if "s" in t.columns) == 1 + sum(len(n) > 1 for n in near.values())  # x1 or x2 is no leaf


def test_searches_end_beside_their_target_and_draw_as_before(spark):
    rows = bushy()
    near = neighbours(rows)
    got = {r.node: r.betweenness for r in gx.betweenness_sampled(frame(spark, rows), seed=2, samples=400).collect()}
    exact = shares(near)
    assert set(got) == set(exact)
    assert max(abs(got[v] - exact[v]) for v in exact) < 0.08
    assert all(got[v] == 0 for v in near if len(near[v]) == 1)
    e = frame(spark, both_ways({(f"p{i:02}", f"p{i + 1:02}") for i in range(12)} | {("p03", f"q{i}") for i in range(30)})).select("src", "dst").localCheckpoint()
    levels, reached, _ = gx._paths_between(e, spark.createDataFrame([("e", "p00", "p02")], "event_id string, from string, to string"))
    assert [level.count() for level in levels] == [1, 1] and [tuple(r) for r in reached.collect()] == [("e", "p02", 2)]


def test_distinct_counts_carry_no_sketches(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("b"))
    out = qc.cardinality(df, ["a", "b"])
    assert {r.column_name: r.exact for r in out.collect()} == {"a": 7, "b": 666}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
