"""Small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantised(x: Column, digits: int = 6) -> Column:
    """Rounded half up through floor, which gives the same double on every engine."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: quantised(F.col(n)) for n in names})


def mid_rank(rank: Column, ties: Column) -> Column:
    return rank + (ties - 1) / 2


def tokens(text: Column) -> Column:
    """Lower-case words of the letters of any script."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]", " "), " "), lambda w: w != "")
