"""Ranks and quantiles without a group in one task, against Spark's window functions and percentile()."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ripplemark.functions import quantiles, ranking
from ripplemark.operators import backtest as bt
from ripplemark.operators import eventstudy as es
from ripplemark.operators import exposure as gx
from ripplemark.operators import quality as qc
from ripplemark.plans import registry


def same(a, b) -> bool:
    b = b.select(a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def scores(spark):
    """A group with most rows, a null one, ties, null scores and repeated rows."""
    g = F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "cold")
    v = F.when(F.col("id") % 97 == 0, None).otherwise(F.hash("id") % 40)
    return spark.range(6000).select(g.alias("g"), v.alias("v"), "id").cache()


def test_positions_and_ntiles_equal_the_window_functions(scores):
    by = Window.partitionBy("g")
    want = scores.select("*", (F.row_number().over(by.orderBy("v", "id")) - 1).alias("pos"), F.count("*").over(by).alias("n"))
    assert same(ranking.positions(scores, ["g"], ["v", "id"], "pos", "n"), want)
    for q in (7, 5000):
        assert same(ranking.ntiles(scores, ["g"], [F.desc("v"), "id"], q), scores.withColumn("bucket", F.ntile(q).over(by.orderBy(F.desc("v"), "id"))))


def test_positions_of_one_group_and_of_none(spark, scores):
    want = scores.select("*", (F.row_number().over(Window.orderBy("id")) - 1).alias("pos"))
    assert same(ranking.positions(scores, [], ["id"]), want)
    assert ranking.positions(scores.filter("id < 0"), ["g"], ["id"]).count() == 0


def test_repeated_rows_are_dealt_to_several_ranges(spark):
    rows = spark.range(8000).select(F.lit(1).alias("g"), F.lit(2).alias("v"))
    got = ranking.positions(rows, ["g"], ["v"], "pos")
    assert sorted(r.pos for r in got.collect()) == list(range(8000))
    spread = rows.withColumn("_salt", F.rand(7)).repartitionByRange(4, "g", "v", "_salt").groupBy(F.spark_partition_id()).count()
    assert spread.agg(F.max("count")).first()[0] < 4000


@pytest.mark.parametrize("descending", [False, True])
def test_ranked_values(scores, descending):
    order = F.desc("v") if descending else F.asc("v")
    by = Window.partitionBy("g")
    o = by.orderBy(order)
    want = scores.select("g", "v", F.count("*").over(Window.partitionBy("g", "v")).alias("n"), F.rank().over(o).alias("rnk"), F.dense_rank().over(o).alias("dense"), F.count("*").over(by).alias("total")).distinct()
    assert same(ranking.ranked_values(scores, ["g"], "v", descending), want)


def test_running_sums_of_several_levels(scores):
    rows = scores.select("g", "id", F.lit(3).alias("x"))
    placed = ranking.positions(rows, ["g"], ["id"], "pos")
    got = ranking.running(placed, ["g"], "pos", "x", "before", "total", block=5)
    assert got.filter("before <> 3 * pos").count() == 0
    assert same(got.select("g", "total").distinct(), rows.groupBy("g").agg(F.sum("x").alias("total")))


def exact(df, qs, by, **how):
    got = quantiles.exact_quantiles(df, "v", qs, by, **how)
    return {(*(r[b] for b in by), r.q): r.value for r in got.collect()}


def percentile(df, qs, by):
    rows = df.groupBy(*by).agg(F.percentile("v", qs).alias("e")).collect()
    return {(*(r[b] for b in by), q): r.e[i] for r in rows if r.e for i, q in enumerate(qs)}


QS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]


@pytest.mark.parametrize(("kind", "bound"), [("ties", 40), ("tails", 40), ("two values", 40), ("distinct", 40), ("ties", 100_000)])
def test_quantiles_equal_percentile(spark, kind, bound):
    rng = random.Random(1)
    draw = {"ties": lambda i: float(rng.randint(0, 5)), "tails": lambda i: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300), "two values": lambda i: float(i % 2), "distinct": lambda i: i * 7919 % 3001 / 7}[kind]
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None]), draw(i)) for i in range(3000)] + [("hot", None), ("none", None), ("one", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    assert exact(df, QS, ["g"], bound=bound) == pytest.approx(percentile(df, QS, ["g"]))
    if kind == "ties":
        assert exact(df, QS, [], bound=bound) == pytest.approx(percentile(df, QS, []))


def test_quantiles_of_nan_and_of_nothing(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(200)] + [("a", float("nan"))] * 3, "g string, v double")
    got = exact(df, [0.5, 1.0], ["g"], bound=20)
    assert got["a", 0.5] == 101.0 and got["a", 1.0] != got["a", 1.0]
    assert exact(df.filter("v < 0"), [0.5], ["g"]) == {}


def test_outliers_and_quantiles_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BOUND", 50)
    monkeypatch.setattr(quantiles.exact_quantiles, "__defaults__", (50,))
    df = spark.range(1500).select(F.when(F.col("id") % 5 == 0, None).otherwise("a").alias("g"), (F.hash("id") % 1000).cast("double").alias("v"), "id").unionByName(spark.createDataFrame([("a", 1e6, -1), (None, -1e6, -2)], "g string, v double, id bigint"))
    assert sorted(r.id for r in qc.outliers(df, "v", ["g"], 5.0).collect()) == [-2, -1]
    got = {(r.g, r.q): r.exact for r in qc.quantiles(df, "v", [0.1, 0.5], ["g"]).collect()}
    assert got == pytest.approx(percentile(df, [0.1, 0.5], ["g"]))


def test_ranks_of_exposure_equal_the_window_functions(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["e", "e", "f"]), f"n{i}", "m", rng.choice([0.5, 0.25, i / 1000])) for i in range(900)] + [("alone", "n", "m", 1.0), ("flat", "a", "m", 2.0), ("flat", "b", "m", 2.0)]
    df = spark.createDataFrame(rows, "event_id string, node string, measure string, score double")
    by = Window.partitionBy("event_id", "measure")
    o, low, high = by.orderBy(F.desc("score")), F.min("score").over(by), F.max("score").over(by)
    want = df.withColumns({"rnk": F.dense_rank().over(o), "pct": F.percent_rank().over(o), "scaled": F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(0.0), "r": F.row_number().over(by.orderBy(F.desc("score"), "node"))})
    assert same(gx.rank_exposure(df), want.drop("r"))
    assert same(gx.rank_exposure(df, 7), want.filter("r <= 7").drop("r"))


def test_car_by_exposure_equals_ntile(spark):
    rows = [(f"e{i % 40}", i, -1, 1, i * 37 % 101 / 10) for i in range(400)]
    cars = spark.createDataFrame(rows, "event_id string, ent bigint, t1 int, t2 int, car double")
    exposure = cars.select("event_id", "ent", F.lit("m").alias("measure"), (F.col("ent") % 7).cast("double").alias("score"))
    by = cars.join(exposure, ["event_id", "ent"]).withColumn("bucket", F.ntile(4).over(Window.partitionBy("measure", "t1", "t2").orderBy("score", "event_id", "ent")))
    want = {r.bucket: (r.m, r.n) for r in by.groupBy("bucket").agg(F.avg("car").alias("m"), F.count("*").alias("n")).collect()}
    got = {r.bucket: (r.mean_car, r.n) for r in es.car_by_exposure(cars, exposure, 4).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert {k: v[0] for k, v in got.items()} == pytest.approx({k: v[0] for k, v in want.items()})


def test_spread_cross_sections_equal_the_windows(spark):
    rng = random.Random(4)
    rows = [(e, d, rng.choice([0.1, 0.2, rng.random()]), rng.choice([0.0, rng.random(), None])) for d in range(3) for e in range(150)]
    df = spark.createDataFrame(rows, "ent int, dt int, score double, ret double").cache()
    assert same(bt.bucket(df, 7, spread=True), bt.bucket(df, 7))
    value = lambda spread: {r.dt: (r.n, round(r.ic, 9)) for r in bt.information_coefficient(df.drop("ret"), df.drop("score"), spread).collect()}
    assert value(True) == value(False)


@pytest.mark.parametrize("name", ["qc_quantiles", "qc_outliers", "kg_stats"])
def test_no_percentile_over_a_group(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString().lower()
    assert "percentile(" not in plan and "median(" not in plan
