"""Operators on tiny frames with answers worked out by hand."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ripplemark.operators import backtest as bt
from ripplemark.operators import eventstudy as es
from ripplemark.operators import exposure as gx
from ripplemark.operators import ingest, kg
from ripplemark.operators import quality as qc


def day(n: int) -> dt.date:
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def edges(spark, *rows):
    both = [(a, b, w) for a, b, w in rows] + [(b, a, w) for a, b, w in rows]
    return spark.createDataFrame(both, "src string, dst string, w double")


def seeds(spark, *nodes):
    return spark.createDataFrame([("e", n, 1.0 / len(nodes)) for n in nodes], "event_id string, node string, w double")


def values(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_hop_distance(spark):
    e = edges(spark, ("A", "B", 1.0), ("B", "C", 1.0), ("C", "D", 1.0), ("E", "F", 1.0))
    assert values(gx.hop_distance(e, seeds(spark, "A"), 5), "node", "hops") == {"A": 0, "B": 1, "C": 2, "D": 3}


def test_unknown_seed_reaches_nothing(spark):
    assert values(gx.hop_distance(edges(spark, ("A", "B", 1.0)), seeds(spark, "Z"), 3), "node", "hops") == {"Z": 0}


def test_weighted_distance(spark):
    e = spark.createDataFrame([("A", "B", 0.5), ("B", "C", 0.5), ("A", "C", 0.2)], "src string, dst string, w double")
    assert values(gx.weighted_distance(e, seeds(spark, "A"), 3), "node", "cost")["C"] == pytest.approx(-math.log(0.25))


def test_shortest_path_prefers_least_predecessor(spark):
    e = edges(spark, ("A", "C", 1.0), ("A", "B", 1.0), ("B", "D", 1.0), ("C", "D", 1.0))
    h = gx.hop_distance(e, seeds(spark, "A"), 3)
    assert values(gx.shortest_path(h, e, 3), "node", "path")["D"] == ["A", "B", "D"]


def test_rwr(spark):
    p = kg.transition(edges(spark, ("A", "B", 1.0)))
    one = values(gx.rwr(p, seeds(spark, "A"), 0.15, 1), "node", "score")
    assert one == pytest.approx({"A": 0.15, "B": 0.85})
    many = values(gx.rwr(p, seeds(spark, "A"), 0.15, 40, every=10), "node", "score")
    assert many["A"] == pytest.approx(0.15 / 0.2775, abs=2e-3)
    assert sum(many.values()) == pytest.approx(1)


def test_rwr_returns_dead_end_mass(spark):
    p = spark.createDataFrame([("A", "B", 1.0)], "src string, dst string, p double")
    assert sum(values(gx.rwr(p, seeds(spark, "A"), 0.15, 6), "node", "score").values()) == pytest.approx(1)


def test_pagerank_cycle(spark):
    p = kg.transition(spark.createDataFrame([("A", "B", 1.0), ("B", "C", 1.0), ("C", "A", 1.0)], "src string, dst string, w double"))
    assert values(gx.pagerank(p, 0.85, 10), "node", "score") == pytest.approx({"A": 1 / 3, "B": 1 / 3, "C": 1 / 3})


def test_betweenness_and_closeness(spark):
    e = edges(spark, ("A", "B", 1.0), ("B", "C", 1.0))
    nodes = spark.createDataFrame([("A",), ("B",), ("C",)], "node string")
    assert {k: v / 2 for k, v in values(gx.betweenness(e, nodes, 3), "node", "betweenness").items()} == pytest.approx({"A": 0, "B": 1, "C": 0})
    assert values(gx.closeness(e, nodes, 3), "node", "closeness") == pytest.approx({"A": 0.75, "B": 1.0, "C": 0.75})


def test_kg_edges_clean_up(spark):
    e = spark.createDataFrame([(" A", "B", "r", 1.0), ("A", "B", "r", 2.0), ("A", "A", "r", 1.0), (None, "B", "r", 1.0), ("A", "C", "r", 0.0)], "src string, dst string, rel string, w double")
    assert [tuple(r) for r in kg.kg_edges(e).collect()] == [("A", "B", "r", 2.0)]


def test_seed_vector_counts_unknown_nodes(spark):
    nodes = spark.createDataFrame([("A",), ("B",)], "node string")
    tags = spark.createDataFrame([("e", "A", 1.0), ("e", "B", 3.0), ("e", "Z", 1.0)], "event_id string, node string, w double")
    vector, dropped = kg.seed_vector(tags, nodes)
    assert values(vector, "node", "w") == {"A": 0.25, "B": 0.75}
    assert values(dropped, "event_id", "dropped") == {"e": 1}


def test_market_model_exact_fit(spark):
    rows = [("e", 1, tau, 0.001 + 1.2 * m + (0.05 if tau == 0 else 0.0), m) for tau in range(-60, 6) for m in [math.sin(tau) / 50]]
    w = spark.createDataFrame(rows, "event_id string, ent bigint, tau int, ret double, mret double")
    f = es.fit_market_model(w)
    r = f.first()
    assert (r.alpha, r.beta, r.n) == (pytest.approx(0.001), pytest.approx(1.2), 50)
    c = es.car(es.abnormal_returns(w, f), [(-1, 1)]).first()
    assert (c.car, c.scar, c.n) == (pytest.approx(0.05), None, 3)


def test_drop_overlaps(spark):
    a = spark.createDataFrame([(str(b), 1, b) for b in (1, 4, 7, 20)], "event_id string, ent bigint, bar bigint")
    assert sorted(r.bar for r in es.drop_overlaps(a, 5).collect()) == [1, 7, 20]


def test_equity_and_drawdown(spark):
    r = spark.createDataFrame([(day(i), 1, x) for i, x in enumerate((0.1, -0.5, 0.2))], "dt date, bucket int, net double")
    falls = bt.drawdown(bt.equity_curve(r))
    assert [x.equity for x in falls.orderBy("dt").collect()] == pytest.approx([1.1, 0.55, 0.66])
    deep = bt.max_drawdown(falls).first()
    assert (deep.max_drawdown, deep.peak, deep.trough) == (pytest.approx(-0.5), day(0), day(1))


def test_equity_is_null_after_total_loss(spark):
    r = spark.createDataFrame([(day(i), 1, x) for i, x in enumerate((0.1, -1.0, 0.2))], "dt date, bucket int, net double")
    assert [x.equity for x in bt.equity_curve(r).orderBy("dt").collect()] == [pytest.approx(1.1), None, None]


def test_turnover_and_net(spark):
    w = spark.createDataFrame([(day(0), 1, "A", 0.5), (day(0), 1, "B", 0.5), (day(1), 1, "B", 0.5), (day(1), 1, "C", 0.5)], "dt date, bucket int, ent string, weight double")
    turn = bt.turnover(w)
    assert values(turn, "dt", "turnover") == {day(0): 0.5, day(1): 0.5}
    gross = spark.createDataFrame([(day(1), 1, 0.01)], "dt date, bucket int, gross double")
    assert bt.net_returns(gross, turn).first().net == pytest.approx(0.009)


def test_no_look_ahead(spark):
    rows = [(1, day(i), i, float(i)) for i in range(6)]
    schema = "ent bigint, dt date, bar bigint, score double"
    past = bt.lag_signal(spark.createDataFrame(rows, schema)).filter(F.col("bar") <= 3).orderBy("bar").collect()
    changed = [r if r[2] < 3 else (*r[:3], 99.0) for r in rows]
    assert bt.lag_signal(spark.createDataFrame(changed, schema)).filter(F.col("bar") <= 3).orderBy("bar").collect() == past
    with pytest.raises(ValueError):
        bt.lag_signal(spark.createDataFrame(rows, schema), 0)


def test_carry_forward(spark):
    px = [(1, day(0), 10.0, 1.0), (1, day(4), 11.0, 1.0), *((2, day(i), 5.0, 1.0) for i in range(5))]
    p = ingest.price_panel(spark.createDataFrame(px, "ent bigint, dt date, px double, vol double"), 2)
    assert [r.px for r in p.filter("ent = 1").orderBy("dt").collect()] == [10, 10, 10, None, 11]


def test_one_bar_entity_has_no_return(spark):
    p = ingest.price_panel(spark.createDataFrame([(1, day(0), 10.0, 1.0)], "ent bigint, dt date, px double, vol double"))
    assert [r.ret for r in ingest.returns(p).collect()] == [None]


def test_coverage_and_stale_runs(spark):
    schema = "ent bigint, dt date, px double"
    p = spark.createDataFrame([(1, day(i), 1.0) for i in (0, 1, 4)] + [(2, day(i), float(i)) for i in range(5)], schema)
    r = qc.coverage(p, p.select("dt")).filter("ent = 1").first()
    assert (r.present, r.expected, r.longest_gap) == (3, 5, 2)
    s = spark.createDataFrame([(1, day(i), x) for i, x in enumerate((5.0, 5.0, 5.0, 6.0, 6.0))], schema)
    assert [(x.start, x.end, x.length) for x in qc.stale_runs(s, 3).collect()] == [(day(0), day(2), 3)]


def test_outliers_without_spread(spark):
    d = spark.createDataFrame([("a", 1.0)] * 5 + [("a", 9.0)], "g string, x double")
    assert qc.outliers(d, "x", ["g"]).count() == 0


def test_filing_asof(spark):
    f = spark.createDataFrame([(1, "A", dt.datetime(2024, 1, 5)), (2, "A", dt.datetime(2024, 1, 9))], "filing_id bigint, ent string, filed_at timestamp_ntz")
    ask = spark.createDataFrame([("A", dt.date(2024, 1, 9)), ("A", dt.date(2024, 1, 10)), ("A", dt.date(2024, 1, 1)), ("B", dt.date(2024, 1, 9))], "ent string, dt date")
    got = {(r.ent, r.dt.day): r.filing_id for r in ingest.filing_asof(ask, f).collect()}
    assert got == {("A", 9): 1, ("A", 10): 2, ("A", 1): None, ("B", 9): None}


def test_dedup_articles(spark):
    rows = [(1, dt.datetime(2024, 1, 2), " HTTP://X.com/a/?ref=x", "x", "en", "t", "one"), (2, dt.datetime(2024, 1, 1), "http://x.com/a", "x", "en", "t", "two"), (3, dt.datetime(2024, 1, 3), "http://x.com/b", "x", "en", "t", "TWO ")]
    a = spark.createDataFrame(rows, "article_id bigint, published_at timestamp_ntz, url string, domain string, lang string, title string, text string")
    assert [r.article_id for r in ingest.dedup_articles(ingest.normalise_articles(a)).collect()] == [2]


def test_empty_inputs(spark):
    p = spark.createDataFrame([], "ent bigint, dt date, px double, vol double")
    assert ingest.returns(ingest.price_panel(p)).count() == 0
    e = spark.createDataFrame([], "src string, dst string, w double")
    assert gx.connected_components(e).count() == 0
    assert kg.transition(kg.symmetrise(e)).count() == 0
