"""Range joins by bins and greedy events against plain Python."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ripplemark.functions import ranges
from ripplemark.operators import eventstudy as es


@pytest.mark.parametrize("width", [1, 4, 50])
def test_range_join_equals_all_pairs(spark, width):
    rng = random.Random(width)
    points = [(rng.choice("ab"), rng.randint(-60, 60), i) for i in range(80)]
    spans = [(rng.choice("abc"), low := rng.randint(-60, 60), low + rng.randint(0, 30), i) for i in range(50)]
    got = ranges.range_join(spark.createDataFrame(points, "k string, at int, p int"), ["k"], "at", spark.createDataFrame(spans, "k string, low int, high int, s int"), "low", "high", width)
    want = sorted((p, s) for k, at, p in points for j, low, high, s in spans if k == j and low <= at <= high)
    assert sorted((r.p, r.s) for r in got.collect()) == want


def test_one_entity_with_many_events_and_bars(spark):
    """10,000 events by 10,000 bars: what meets is near what comes out, in many keys."""
    bars, events = spark.range(10_000).select(F.lit("A").alias("ent"), "id"), spark.range(10_000).select(F.lit("A").alias("ent"), (F.col("id") - 60).alias("low"), (F.col("id") + 5).alias("high"))
    p, s = ranges.binned(bars, "id", events, "low", "high", 66)
    met = p.join(s, ["ent", "_bin"]).groupBy("_bin").count().agg(F.sum("count"), F.max("count"), F.count("*")).first()
    out = ranges.range_join(bars, ["ent"], "id", events, "low", "high", 66).count()
    assert out > 650_000 and met[0] < 3 * out and met[1] < met[0] / 100 and met[2] > 100


def test_alignment_takes_the_first_bar_in_reach(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    rng = random.Random(3)
    bars = [("AB"[i % 2], day(d), i) for i, d in enumerate(sorted(rng.sample(range(300), 60)))]
    events = [(f"e{i}", rng.choice("ABC"), day(rng.randint(-20, 310))) for i in range(90)]
    got = es.align_events(spark.createDataFrame(events, "event_id string, ent string, dt date"), spark.createDataFrame(bars, "ent string, dt date, bar int"), 14)
    want = {}
    for e, ent, d in events:
        near = [(b, n) for x, b, n in bars if x == ent and 0 <= (b - d).days <= 14]
        if near:
            want[e] = (min(b for b, _ in near), min(n for _, n in near))
    assert {r.event_id: (r.bar_dt, r.bar) for r in got.collect()} == want


def greedy(bars: list[int], gap: int) -> list[int]:
    out: list[int] = []
    for b in sorted(set(bars)):
        if not out or b - out[-1] > gap:
            out.append(b)
    return out


@pytest.mark.parametrize(("gap", "width"), [(0, 4096), (1, 8), (5, 20), (5, 4096), (40, 64)])
def test_greedy_events(spark, gap, width):
    rng = random.Random(gap)
    data = {"A": [rng.randint(-50, 400) for _ in range(150)], "B": [rng.randint(0, 10_000) for _ in range(60)], "C": [7, 7, 7], "D": list(range(0, 300, 3))}
    rows = [(f"{e}{i}", e, b) for e, bars in data.items() for i, b in enumerate(bars)] + [("none", None, 3)]
    got: dict = {}
    for r in es.drop_overlaps(spark.createDataFrame(rows, "event_id string, ent string, bar int"), gap, width).collect():
        got.setdefault(r.ent, []).append(r.bar)
    for e, bars in data.items():
        kept = set(greedy(bars, gap))
        assert sorted(got[e]) == sorted(b for b in bars if b in kept)


def test_a_long_chain_of_events(spark):
    """An event every third bar: one chain of 3,000 pointers through many bins."""
    bars = spark.range(9000).select(F.col("id").cast("string").alias("event_id"), F.lit("A").alias("ent"), (3 * F.col("id")).alias("bar"))
    got = es.drop_overlaps(bars, 5, 64)
    assert sorted(r.bar for r in got.collect()) == list(range(0, 27_000, 6))
