"""Long paths, convergence, early stops, headers in any order, gates and routes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ripplemark.functions.numeric import tokens
from ripplemark.operators import exposure as gx
from ripplemark.operators import kg
from ripplemark.operators import quality as qc
from ripplemark.plans import registry
from ripplemark.sources import readers


def test_components_of_a_long_path(spark):
    n = 600
    order = [(i * 7919) % n for i in range(n)]  # a path that visits the numbers out of order
    e = spark.createDataFrame([(f"{a:05}", f"{b:05}") for a, b in zip(order, order[1:], strict=False)] + [("x", "y"), ("z", "z")], "src string, dst string")
    got = {r.node: r.component for r in gx.connected_components(e).collect()}
    assert len(got) == n + 3
    assert {v for k, v in got.items() if k.isdigit()} == {"00000"}
    assert (got["x"], got["y"], got["z"]) == ("x", "x", "z")


def test_walk_stops_when_it_has_settled(spark):
    p = kg.transition(kg.symmetrise(spark.createDataFrame([("A", "B", 1.0)], "src string, dst string, w double")))
    seeds = spark.createDataFrame([("e", "A", 1.0)], "event_id string, node string, w double")
    got = {r.node: r.score for r in gx.rwr(p, seeds, 0.15, 500, tol=1e-7).collect()}
    assert got == pytest.approx({"A": 0.15 / 0.2775, "B": 1 - 0.15 / 0.2775}, abs=1e-6)
    short = {r.node: r.score for r in gx.rwr(p, seeds, 0.15, 500, tol=0.5).collect()}
    assert abs(short["A"] - got["A"]) > 1e-3


def test_walk_without_rows(spark):
    p = spark.createDataFrame([], "src string, dst string, p double")
    seeds = spark.createDataFrame([], "event_id string, node string, w double")
    assert gx.rwr(p, seeds, iters=10, tol=1e-3).count() == 0


def test_distances_stop_early_and_lose_nothing(spark):
    e = spark.createDataFrame([("A", "B", 0.5), ("B", "C", 0.5), ("A", "C", 0.2)], "src string, dst string, w double")
    seeds = spark.createDataFrame([("e", "A")], "event_id string, node string")
    assert {r.node: r.hops for r in gx.hop_distance(e, seeds, 50).collect()} == {"A": 0, "B": 1, "C": 1}
    assert {r.node: r.cost for r in gx.weighted_distance(e, seeds, 50).collect()} == pytest.approx({"A": 0, "B": 0.6931472, "C": 1.3862944})


def test_betweenness_of_a_sample_is_scaled(spark):
    e = kg.symmetrise(spark.createDataFrame([("A", "B", 1.0), ("B", "C", 1.0)], "src string, dst string, w double"))
    value = lambda pivots, **k: {r.node: r.betweenness for r in gx.betweenness(e, spark.createDataFrame([(p,) for p in pivots], "node string"), 9, **k).collect()}
    assert value("ABC", symmetric=True) == pytest.approx({"A": 0, "B": 1, "C": 0})
    assert value("A", symmetric=True) == pytest.approx({"A": 0, "B": 1.5, "C": 0})
    assert value("A", scaled=False) == pytest.approx({"A": 0, "B": 1, "C": 0})


def test_headers_in_any_order(spark, tmp_path):
    (tmp_path / "a_combined.csv").write_text("name,ent,sector,country\nfirst,A,s,c\n")
    (tmp_path / "b_combined.csv").write_text("country,extra,ent,name\nd,1,A,second\nd,2,B,other\n")
    got = {r.ent: (r["name"], r.sector, r.country) for r in readers.read_universe(spark, str(tmp_path / "*_combined.csv")).collect()}
    assert got == {"A": ("first", "s", "c"), "B": ("other", None, "d")}
    (tmp_path / "e.csv").write_text("dst,src,rel,w\nB,A,r,0.5\n")
    r = readers.read_seed_edges(spark, str(tmp_path / "e.csv")).first()
    assert (r.src, r.dst, r.rel, r.w) == ("A", "B", "r", 0.5)
    (tmp_path / "n.csv").write_text('text,article_id,title\n"two\nlines",1,t\nbody,x,t\n')
    good, bad = readers.read_articles(spark, str(tmp_path / "n.csv"))
    assert [(r.article_id, r.text, r.url) for r in good.collect()] == [(1, "two\nlines", None)]
    assert len(bad.collect()) == 1
    (tmp_path / "p.csv").write_text("vol,px,dt,ent\n2,1.5,2024-01-01,A\n")
    assert readers.read_prices(spark, str(tmp_path / "p.csv")).first().px == 1.5


def test_files_that_disagree_are_not_read_silently(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("src,dst,rel,w\nA,B,r,0.5\n")
    (tmp_path / "in/b.csv").write_text("dst,src,rel,w\nB,A,r,0.5\n")
    with pytest.raises(Exception, match="(?i)header|CSV"):
        readers.read_seed_edges(spark, str(tmp_path / "in")).collect()


def test_missing_values_do_not_pass(spark):
    metrics = spark.createDataFrame([("t", "a", "m", None), ("t", "b", "m", 1.0), ("u", "a", "other", 0.0), ("v", "a", "m", 1.0), ("w", "a", "m", float("nan"))], "table_name string, column_name string, metric string, value double")
    report = qc.data_quality_report(metrics, spark.createDataFrame([("m", 0.9, 0.5)], "metric string, warn double, fail double"))
    assert {(r.table_name, r.column_name): r.verdict for r in report.collect()} == {("t", "a"): "fail", ("t", "b"): "pass", ("u", "a"): "unchecked", ("v", "a"): "pass", ("w", "a"): "fail"}
    gate = qc.quality_gate(report)
    assert {r.table_name: r.verdict for r in gate.collect()} == {"t": "fail", "u": "unchecked", "v": "pass", "w": "fail"}
    df = spark.range(5)
    for name, kept in (("t", 0), ("u", 5), ("v", 5), ("nowhere", 5)):
        passed, aside = qc.routed(df, name, gate)
        assert (passed.count(), aside.count()) == (kept, 5 - kept)


def test_orphans_and_exact_profile(spark):
    child, parent = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1,), (1,)], "p int")
    assert sorted((r.k for r in qc.orphans(child, parent, "k", "p").collect()), key=repr) == [2, None]
    assert [r["distinct"] for r in qc.profile(child, exact=True).collect()] == [2]


def test_tokens_keep_accents(spark):
    row = spark.createDataFrame([("Über déjà-vu, Straße 9 año",)], "t string").select(tokens(F.col("t")).alias("w")).first()
    assert row.w == ["über", "déjà", "vu", "straße", "año"]


@pytest.mark.parametrize("name", ["es_car_by_exposure", "rp_top_exposed", "bt_vs_benchmark"])
def test_facts_are_scanned_few_times(spark, name):
    """What the final plan still reads is written tables, not lineitem over and over."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 0
