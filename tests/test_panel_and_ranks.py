"""Panels and ranks of dates with one shuffle of the rows for each."""

from __future__ import annotations

import random
from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ripplemark.functions.lineage import cut
from ripplemark.functions.numeric import mid_rank
from ripplemark.functions.ranking import mid_ranks
from ripplemark.operators import backtest as bt
from ripplemark.operators import ingest
from ripplemark.plans import event_queries as eq
from ripplemark.plans import fixtures as fx


def test_scores_and_returns_need_one_shuffle_by_entity(spark):
    plan = eq.scored(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ent") == 1
    assert "SortMergeJoin" not in plan


def test_panel_keeps_gaps_doubles_and_nulls(spark):
    day = lambda n: date(2024, 1, n)
    px = [(1, day(2), 10.0, 1.0), (1, day(5), None, 2.0), (2, day(1), 7.0, 3.0), (2, day(1), 7.0, 3.0), (3, day(5), 4.0, 1.0), (None, day(1), 1.0, 1.0), (1, None, 1.0, 1.0), (2, day(3), 8.0, None)]
    got = sorted(ingest.price_panel(spark.createDataFrame(px, "ent bigint, dt date, px double, vol double")).collect())
    one = [(1, day(2), 10.0, 1.0, 1), (1, day(3), 10.0, 0.0, 2), (1, day(5), 10.0, 2.0, 3)]
    two = [(2, day(1), 7.0, 3.0, 1), (2, day(1), 7.0, 3.0, 2), (2, day(2), 7.0, 0.0, 3), (2, day(3), 8.0, 0.0, 4), (2, day(5), 8.0, 0.0, 5)]
    assert got == [*one, *two, (3, day(5), 4.0, 1.0, 1)]


def test_mid_ranks_of_cut_groups_equal_the_windows(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "a", "b"]), rng.choice([0.0, 0.5, round(rng.random(), 3)]), rng.choice([-1.0, round(rng.random(), 2)])) for _ in range(3000)] + [("alone", 1.0, 1.0), ("flat", 2.0, 0.0), ("flat", 2.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    by = Window.partitionBy("g")
    rank = lambda c: mid_rank(F.rank().over(by.orderBy(c)), F.count("*").over(Window.partitionBy("g", c)))
    want = {(r.g, r.x, r.y): (r.a, r.b, r.n) for r in df.select("*", rank("x").alias("a"), rank("y").alias("b"), F.count("*").over(by).alias("n")).collect()}
    counted = cut(df.groupBy("g", "x", "y").agg(F.count("*").alias("m")))
    for chunk in (7, 100, 10_000):
        got = mid_ranks(counted, ["g"], {"x": "a", "y": "b"}, "m", "n", chunk).collect()
        assert len(got) == len(want) and {(r.g, r.x, r.y): (r.a, r.b, r.n) for r in got} == want


def test_coefficient_of_cut_dates_equals_the_windows(spark):
    rng = random.Random(6)
    rows = [(e, d, rng.choice([0.1, rng.random()]), rng.choice([0.0, rng.random(), None])) for d in range(3) for e in range(400)] + [(1, 9, 0.5, 0.5), (2, 9, 0.5, 0.7), (1, 10, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "ent int, dt int, score double, ret double").cache()
    value = lambda *a: {r.dt: (r.n, r.ic if r.ic is None else round(r.ic, 9)) for r in bt.information_coefficient(*a).collect()}
    want = value(df.drop("ret"), df.drop("score"))
    assert want[9] == (2, None)
    assert value(df) == value(df, None, True) == value(df, None, True, 50) == want


def test_buyers_are_shuffled_once_by_customer(spark):
    plan = fx.seed_edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(o_custkey") == 1


def test_bars_sum_whole_cents(spark):
    want = fx.table(spark, "/root/testdata/sf0.001", "lineitem").groupBy(F.col("l_suppkey").alias("ent"), F.date_trunc("week", "l_shipdate").cast("date").alias("dt")).agg((F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("double") / F.sum("l_quantity")).alias("px"))
    got = fx.bars(spark, "/root/testdata/sf0.001")
    assert "decimal" not in str(got.schema) and sorted(got.select("ent", "dt", "px").collect()) == sorted(want.collect())
