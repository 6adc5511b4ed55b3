"""Joins of points with spans, by bins of the axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def binned(points: DataFrame, at: str | Column, spans: DataFrame, low: str | Column, high: str | Column, width: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column `_bin`: a point is in one bin of `width` integers, a span in all that it touches."""
    number = lambda x: F.floor((F.col(x) if isinstance(x, str) else x) / width)
    return points.withColumn("_bin", number(at)), spans.withColumn("_bin", F.explode(F.sequence(number(low), number(high))))


def range_join(points: DataFrame, keys: list[str], at: str, spans: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """All columns of both sides where low <= at <= high (integers) and the keys agree.

    Rows meet by keys and bin, so that a key with many points and spans is many
    tasks; with a width near the spans' length, at most about three times the
    rows that come out are compared.  Other columns must have different names.
    """
    p, s = binned(points, at, spans, low, high, width)
    return p.join(s, [*keys, "_bin"]).filter((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("_bin")
