"""Report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stage_summary(tables: dict[str, tuple[DataFrame, str | None, str | None]], gate: DataFrame | None = None) -> DataFrame:
    """One row for each named table: rows, entities, date range and verdict; the pair names its entity and date columns."""
    none = F.lit(None)
    rows = [
        df.agg(F.count("*").alias("rows"), (F.count_distinct(ent) if ent else none.cast("long")).alias("entities"), (F.min(dt) if dt else none).cast("date").alias("first"), (F.max(dt) if dt else none).cast("date").alias("last")).select(F.lit(name).alias("stage"), "*")
        for name, (df, ent, dt) in tables.items()
    ]
    out = reduce(DataFrame.unionByName, rows)
    if gate is None:
        return out.withColumn("verdict", F.lit("pass"))
    return out.join(F.broadcast(gate.select(F.col("table_name").alias("stage"), "verdict")), "stage", "left").withColumn("verdict", F.coalesce("verdict", F.lit("pass")))


def top_exposed(exposure: DataFrame, cars: DataFrame, k: int = 5) -> DataFrame:
    """Per event the k most exposed entities with their CAR, if they have one. exposure(event_id, ent, score), cars(event_id, ent, car)."""
    top = exposure.withColumn("rnk", F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("score"), "ent"))).filter(F.col("rnk") <= k)
    return top.join(cars, ["event_id", "ent"], "left")


def rollup_report(cars: DataFrame, universe: DataFrame) -> DataFrame:
    """Mean CAR and count by sector and year with subtotals; cars(ent, dt, car)."""
    rows = cars.join(universe.select("ent", "sector"), "ent").withColumn("year", F.year("dt"))
    return rows.rollup("sector", "year").agg(F.avg("car").alias("mean_car"), F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))
