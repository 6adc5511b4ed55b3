"""Files in, files out; streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ripplemark.sources import readers
from ripplemark.streaming import intake

SF = "/root/testdata/sf0.001"


def test_articles_round_trip(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = d.select(F.col("doc_id").alias("article_id"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("published_at"), F.lit("u").alias("url"), "source", "lang", F.lit("t").alias("title"), "text")
    rows.write.option("escape", '"').csv(str(tmp_path / "a"), header=True)
    good, bad = readers.read_articles(spark, str(tmp_path / "a"))
    want = {r.doc_id: r.text for r in d.collect()}
    assert {r.article_id: r.text for r in good.collect()} == want
    assert bad.collect() == []


def test_malformed_articles_are_kept_aside(spark, tmp_path):
    (tmp_path / "a.csv").write_text('article_id,published_at,url,domain,lang,title,text\n1,2024-01-01T00:00:00,u,d,en,t,"two\nlines"\nx,2024-01-01T00:00:00,u,d,en,t,body\n')
    good, bad = readers.read_articles(spark, str(tmp_path / "a.csv"))
    assert [r.text for r in good.collect()] == ["two\nlines"]
    assert len(bad.collect()) == 1


def test_universe_first_file_wins(spark, tmp_path):
    (tmp_path / "a_combined.csv").write_text("ent,name,sector,country\nA,first,s,c\n")
    (tmp_path / "b_combined.csv").write_text("ent,name,sector,country\nA,second,s,c\nB,other,s,c\n")
    (tmp_path / "tickers.txt").write_text(" a \n\nA\n")
    u = readers.read_universe(spark, str(tmp_path / "*_combined.csv"))
    assert {r.ent: r["name"] for r in u.collect()} == {"A": "first", "B": "other"}
    assert [r.ent for r in readers.restrict(u, readers.read_tickers(spark, str(tmp_path / "tickers.txt"))).collect()] == ["A"]


def test_small_readers(spark, tmp_path):
    (tmp_path / "e.csv").write_text("src,dst,rel,w\nA,B,r,0.5\n")
    (tmp_path / "p.csv").write_text("ent,dt,px,vol\nA,2024-01-01,1.5,2\n")
    (tmp_path / "f.json").write_text('{"filing_id": 1, "ent": "A", "filed_at": "2024-01-05T00:00:00", "form": "10-K", "text": "x"}\n')
    (tmp_path / "k.csv").write_text("keyword,category,weight\nfraud,abuse,1.25\n")
    assert readers.read_seed_edges(spark, str(tmp_path / "e.csv")).first().w == 0.5
    assert readers.read_prices(spark, str(tmp_path / "p.csv")).first().dt == dt.date(2024, 1, 1)
    assert readers.read_filings(spark, str(tmp_path / "f.json")).first().form == "10-K"
    assert str(readers.read_risk_keywords(spark, str(tmp_path / "k.csv")).first().weight) == "1.2500"


def test_writes_replace_only_their_partitions(spark, tmp_path):
    path = str(tmp_path / "out")
    readers.write_processed(spark.createDataFrame([(1, "a"), (2, "b")], "x int, p string"), path, ["p"])
    readers.write_processed(spark.createDataFrame([(3, "b")], "x int, p string"), path, ["p"])
    assert sorted((r.x, r.p) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]
    readers.write_report_tables({"t": spark.range(3)}, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/t")).count() == 3


def test_streams_agree_with_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    for name, op in (("tumbling", intake.tumbling), ("sessions", intake.sessions)):
        stream = intake.read_stream(spark, str(tmp_path / "in"), events.schema)
        q = op(stream, late="40 days").writeStream.format("memory").queryName(name).outputMode("complete" if name == "tumbling" else "append").trigger(availableNow=True).start()
        q.awaitTermination()
        if name == "tumbling":
            assert sorted(map(str, spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n").collect())) == sorted(map(str, op(events).select("start", "event_type", "n").collect()))


def test_stream_intake_drops_repeats(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1), "a b"), (2, dt.datetime(2024, 1, 1), "A  b"), (3, dt.datetime(2024, 1, 1), "c")]
    a = spark.createDataFrame(rows, "article_id bigint, published_at timestamp_ntz, text string")
    a.write.parquet(str(tmp_path / "in"))
    q = intake.dedup_intake(intake.read_stream(spark, str(tmp_path / "in"), a.schema)).writeStream.format("memory").queryName("intake").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("intake").count() == 2


def test_written_tables_are_released(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    from ripplemark.functions import lineage

    lineage.cut(spark.range(3))
    path = Path(urlparse(lineage._made[-1]).path)
    assert list(path.glob("*.parquet"))
    kept = lineage._made[:-1]
    lineage._made[:] = lineage._made[-1:]
    assert lineage.release(spark) == 1 and not path.exists() and lineage.release(spark) == 0
    lineage._made[:] = kept
