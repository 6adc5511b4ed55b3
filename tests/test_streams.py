"""Streams of files: restarts from a checkpoint, late rows, the survivor of equal texts."""

from __future__ import annotations

import datetime as dt

from ripplemark.streaming import intake

EVENTS = "ts timestamp, event_type string, value double"


def at(minute: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=minute)


def test_counts_go_on_after_a_restart_and_leave_late_rows_out(spark, tmp_path):
    landed, out, done = (str(tmp_path / x) for x in ("landed", "out", "done"))

    def land(rows):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(landed)
        intake.upserts(intake.tumbling(intake.read_stream(spark, landed, EVENTS)), out, done)
        return {(r.start.hour, r.event_type): (r.n, r.total) for r in intake.latest(spark, out, ["start", "event_type"]).collect()}

    assert land([(at(5), "a", 1.0), (at(50), "a", 2.0)]) == {(0, "a"): (2, 3.0)}
    assert land([(at(55), "a", 4.0), (at(65), "b", 1.0)]) == {(0, "a"): (3, 7.0), (1, "b"): (1, 1.0)}
    assert land([(at(200), "a", 1.0)])[3, "a"] == (1, 1.0)
    # the watermark is at 190 minutes: the first hour is closed, the fourth is not
    assert land([(at(10), "a", 100.0), (at(185), "a", 5.0)]) == {(0, "a"): (3, 7.0), (1, "b"): (1, 1.0), (3, "a"): (2, 6.0)}
    assert land([])[3, "a"] == (2, 6.0)


def test_intake_keeps_a_defined_article_of_equal_texts(spark, tmp_path):
    landed, out, done = (str(tmp_path / x) for x in ("landed", "out", "done"))
    schema = "article_id bigint, published_at timestamp, text string, other int"

    def land(rows, **how):
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(landed)
        intake.intake(intake.read_stream(spark, landed, schema, 100), out, done, **how)
        return sorted(r.article_id for r in spark.read.parquet(out).collect())

    assert land([(9, at(3), "Same  text", 1), (4, at(3), "same text ", 2), (5, at(1), "other", 3), (1, None, "same\ntext", 4), (6, None, None, 5), (7, at(9), "", 6)]) == [4, 5, 7]
    assert land([(2, at(0), "SAME TEXT", 1), (8, at(10), "new", 2), (3, at(10), "new", 2)]) == [3, 4, 5, 7]
    assert {r.other for r in spark.read.parquet(out).collect()} == {2, 3, 6}


def test_intake_within_some_days(spark, tmp_path):
    landed, out, done = (str(tmp_path / x) for x in ("landed", "out", "done"))
    schema = "article_id bigint, published_at timestamp, text string"
    for rows in ([(1, at(0), "x")], [(2, at(2 * 1440), "x")], [(3, at(40 * 1440), "x")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(landed)
        intake.intake(intake.read_stream(spark, landed, schema, 100), out, done, within=10)
    assert sorted(r.article_id for r in spark.read.parquet(out).collect()) == [1, 3]
