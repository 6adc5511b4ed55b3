"""Exact quantiles of groups of any size, by narrowing: no task sorts or holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.functions.lineage import cut
from ripplemark.functions.ranking import few

#: Rows that one task may sort at the end.
BOUND = 100_000

#: A sketch names so many values at equal steps; its ranks are off by a row in ACCURACY at most.
GRID, ACCURACY = 1000, 10_000


def _on(left: list[str], right: list[str]) -> Column:
    on = F.lit(True)
    for x, y in zip(left, right, strict=True):
        on = on & F.col(x).eqNullSafe(F.col(y))
    return on


def _inside(rows: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each window (wid, keys, low, high): values between low and high, both left out; null is no bound."""
    names = {k: f"_w{k}" for k in keys}
    w = few(windows.select("wid", "low", "high", *[F.col(k).alias(n) for k, n in names.items()]))
    between = (F.col("low").isNull() | (F.col("_v") > F.col("low"))) & (F.col("high").isNull() | (F.col("_v") < F.col("high")))
    return rows.join(w, _on(keys, list(names.values())) & between).select("wid", "_v")


def _narrowed(rows: DataFrame, windows: DataFrame, targets: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """One pass: values(wid, rank, value) found, and (wid, rank, low, high, before, inside) that hold the others.

    A sketch of each window names two values around each wanted rank; rows below,
    at and between these are counted, which shows exactly where the rank lies.
    """
    hits = _inside(rows, windows, keys)
    grid = hits.groupBy("wid").agg(F.percentile_approx("_v", [i / GRID for i in range(GRID + 1)], ACCURACY).alias("s"))
    spot = F.floor((F.col("rank") - F.col("before") + 0.5) / F.col("inside") * GRID).cast("int") + 1
    at = targets.join(windows.select("wid", "before", "inside"), "wid").join(grid, "wid")
    near = at.select("wid", F.array(F.element_at("s", F.greatest(F.lit(1), spot - 2)), F.element_at("s", F.least(F.lit(GRID + 1), spot + 3))).alias("ab"))
    bounds = cut(near.groupBy("wid").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ab")))).alias("bs")))
    b = few(bounds.select(F.col("wid").alias("_b"), "bs"))
    below = F.size(F.filter("bs", lambda x: x < F.col("_v")))
    cells = hits.join(b, F.col("wid") == F.col("_b")).groupBy("wid", (2 * below + F.array_contains("bs", F.col("_v")).cast("int")).alias("cell")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("wid").orderBy("cell"))  # a few cells a window
    cells = cells.withColumn("upto", upto).join(bounds, "wid")
    hit = targets.join(windows.select("wid", "before"), "wid").join(cells.withColumnRenamed("wid", "_c"), (F.col("wid") == F.col("_c")) & (F.col("rank") >= F.col("before") + F.col("upto") - F.col("n")) & (F.col("rank") < F.col("before") + F.col("upto")))
    edge = F.floor(F.col("cell") / 2).cast("int")
    found = hit.select("wid", "rank", (F.col("cell") % 2 == 1).alias("done"), F.try_element_at("bs", edge + 1).alias("next"), F.when(edge > 0, F.try_element_at("bs", F.greatest(edge, F.lit(1)))).alias("last"), (F.col("before") + F.col("upto") - F.col("n")).alias("start"), F.col("n").alias("inside"))
    found = cut(found)
    return found.filter("done").select("wid", "rank", F.col("next").alias("value")), found.filter("NOT done").select("wid", "rank", "last", "next", "start", "inside")


def exact_quantiles(df: DataFrame, col: str, qs: list[float], by: list[str], bound: int = BOUND) -> DataFrame:
    """(by..., q, value): interpolated between the two nearest rows as percentile() does; null values do not count, NaN comes last.

    The rows of a wanted rank's window are narrowed by two orders of magnitude
    or more a pass, all groups and ranks at once, by sketches and counts that
    are combined before any shuffle; windows of at most `bound` rows are sorted.
    """
    keys = [f"_k{i}" for i in range(len(by))] or ["_k0"]
    cols = [F.col(b).alias(k) for b, k in zip(by, keys, strict=False)] if by else [F.lit(0).alias("_k0")]
    rows = cut(df.select(*cols, F.col(col).cast("double").alias("_v")).filter("_v IS NOT NULL"))
    groups = cut(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.isnan("_v")).alias("nan")))
    p = F.col("q") * (F.col("n") - 1)
    wanted = groups.select(*keys, "n", "nan", F.explode(F.array(*[F.lit(float(x)) for x in qs])).alias("q"))
    wanted = cut(wanted.select(*keys, "n", "nan", "q", p.alias("p"), F.floor(p).alias("lo"), F.ceil(p).alias("hi")))
    ranks = wanted.select(*keys, "n", "nan", F.explode(F.array("lo", "hi")).alias("rank")).distinct()
    real = rows.filter(~F.isnan("_v"))
    values = ranks.filter(F.col("rank") >= F.col("n") - F.col("nan")).select(*keys, "rank", F.lit(float("nan")).alias("value"))
    left = ranks.filter(F.col("rank") < F.col("n") - F.col("nan")).select(*keys, "rank", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(0).cast("long").alias("before"), (F.col("n") - F.col("nan")).alias("inside"))
    state = cut(left)
    while True:
        wid = F.sha2(F.to_json(F.struct(*keys, "low", "high"), {"ignoreNullFields": "false"}), 256)
        state = state.withColumn("wid", wid)
        small = state.filter(F.col("inside") <= bound)
        if not small.isEmpty():
            values = values.unionByName(_sorted(real, small, keys))
        large = cut(state.filter(F.col("inside") > bound))
        if large.isEmpty():
            break
        windows = cut(large.groupBy("wid").agg(*[F.first(k).alias(k) for k in keys], F.first("low").alias("low"), F.first("high").alias("high"), F.first("before").alias("before"), F.first("inside").alias("inside")))
        done, rest = _narrowed(real, windows, large.select("wid", "rank"), keys)
        own = windows.select("wid", *keys, F.col("low").alias("l"), F.col("high").alias("h"))
        values = values.unionByName(done.join(own, "wid").select(*keys, "rank", "value"))
        state = cut(rest.join(own, "wid").select(*keys, "rank", F.coalesce("last", "l").alias("low"), F.coalesce("next", "h").alias("high"), F.col("start").alias("before"), "inside"))
    values = cut(values)
    names = {k: f"_v{k}" for k in keys}
    side = lambda n: values.select(*[F.col(k).alias(v) for k, v in names.items()], F.col("rank").alias("_r"), F.col("value").alias(n))
    both = wanted
    for rank, n in (("lo", "a"), ("hi", "b")):
        both = both.join(side(n), _on(keys, list(names.values())) & (F.col(rank) == F.col("_r"))).drop(*names.values(), "_r")
    value = F.when(F.col("lo") == F.col("hi"), F.col("a")).otherwise((F.col("hi") - F.col("p")) * F.col("a") + (F.col("p") - F.col("lo")) * F.col("b"))
    return both.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=False)], "q", value.alias("value"))


def _sorted(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The values at ranks of windows that are small enough to be sorted."""
    windows = cut(state.groupBy("wid").agg(*[F.first(k).alias(k) for k in keys], F.first("low").alias("low"), F.first("high").alias("high")))
    own = _inside(rows, windows, keys).withColumn("_at", F.row_number().over(Window.partitionBy("wid").orderBy("_v")) - 1)
    ask = few(cut(state.select(F.col("wid").alias("_s"), *keys, "rank", "before")))
    return own.join(ask, (F.col("wid") == F.col("_s")) & (F.col("_at") == F.col("rank") - F.col("before"))).select(*keys, "rank", F.col("_v").alias("value"))
