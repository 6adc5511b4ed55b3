"""Streaming: incremental article intake and windowed risk counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema: str, files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def _timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    """A stream with its watermark, which only a timestamp with a zone can carry; a batch as it is."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if df.isStreaming else df


def text_hash() -> Column:
    """Of the column text in lower case, with white space collapsed; null is empty."""
    return F.sha2(F.regexp_replace(F.trim(F.lower(F.coalesce("text", F.lit("")))), r"\s+", " "), 256)


def dedup_intake(articles: DataFrame, ts: str = "published_at", within: str = "10 days") -> DataFrame:
    """One row for each text within the watermark; state older than it is dropped."""
    rows = _timed(articles.withColumn("text_hash", text_hash()), ts, within)
    return rows.dropDuplicatesWithinWatermark(["text_hash"]) if rows.isStreaming else rows.dropDuplicates(["text_hash"])


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = _timed(events, "ts", late)
    return w.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = _timed(events, "ts", late)
    return w.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = _timed(events, "ts", late)
    return w.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


def upserts(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream of changed rows (update mode) over all files that have landed and ends; a later call goes on from the checkpoint.

    A micro-batch writes its rows to path/batch=<number>, so that one that is
    run again after a failure replaces what it had written.
    """

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of what upserts() wrote, for each key the row of the last micro-batch."""
    rows = spark.read.option("basePath", path).parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_r")).select(*keys, "_r.*")


def intake(articles: DataFrame, path: str, checkpoint: str, ts: str = "published_at", key: str = "article_id", within: int | None = None) -> None:
    """Appends the articles of a stream whose text has not been taken in yet (in the `within` days before, if given) to a table; ends and goes on as upserts().

    Of equal texts in a micro-batch the earliest stays, then the least key; what
    an earlier micro-batch took in stays before those of later ones.
    """

    def add(rows: DataFrame, number: int) -> None:
        order = F.struct(F.col(ts).isNull(), F.col(ts), F.col(key).isNull(), F.col(key))
        once = rows.withColumn("text_hash", text_hash()).groupBy("text_hash").agg(F.min_by(F.struct(*rows.columns), order).alias("_r")).select("text_hash", "_r.*")
        if number:
            known = rows.sparkSession.read.option("basePath", path).parquet(path).filter(F.col("batch") < number).select(F.col("text_hash").alias("_h"), F.col(ts).alias("_ts"))
            near = F.col("text_hash") == F.col("_h")
            if within is not None:
                near = near & (F.col("_ts") >= F.col(ts) - F.expr(f"INTERVAL {int(within)} DAYS"))
            once = once.join(known, near, "left_anti")
        once.write.mode("overwrite").parquet(f"{path}/batch={number}")

    articles.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
