"""Set-based backtest: lagged signals, buckets, weights, portfolio returns and their measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.functions.lineage import cut
from ripplemark.functions.numeric import mid_rank, quantised
from ripplemark.functions.ranking import CHUNK, mid_ranks, ntiles


def lag_signal(signal: DataFrame, lag: int = 1) -> DataFrame:
    """signal(ent, dt, bar, score): the score known `lag` bars earlier; the first bars have none."""
    if lag < 1:
        raise ValueError("lag must be 1 or more")
    return signal.withColumn("score", F.lag("score", lag).over(Window.partitionBy("ent").orderBy("bar"))).filter("score IS NOT NULL")


def rebalance_dates(calendar: DataFrame, every: str = "month") -> DataFrame:
    """The first date of each period."""
    return calendar.groupBy(F.date_trunc(every, "dt").cast("date").alias("period")).agg(F.min("dt").alias("dt"))


def bucket(signal: DataFrame, q: int = 5, spread: bool = False) -> DataFrame:
    """Per date q buckets by quantised score, then entity; `spread` deals a date's entities to many tasks, for cross-sections that one cannot sort."""
    if not spread:
        return signal.withColumn("bucket", F.ntile(q).over(Window.partitionBy("dt").orderBy(quantised(F.col("score")), "ent")))
    rows = cut(signal.withColumn("_order", quantised(F.col("score"))))
    return ntiles(rows, ["dt"], ["_order", "ent"], q).drop("_order")


def weights(buckets: DataFrame, how: str = "equal") -> DataFrame:
    """Weights that sum to 1 by (dt, bucket), equal or by volume; the totals are aggregated and joined."""
    mass = F.lit(1.0) if how == "equal" else F.col("vol")
    total = buckets.groupBy("dt", "bucket").agg(F.sum(mass).alias("_t"))
    return buckets.join(total, ["dt", "bucket"]).filter("_t > 0").withColumn("weight", mass / F.col("_t")).drop("_t")


def portfolio_returns(w: DataFrame, rets: DataFrame | None = None) -> DataFrame:
    """Weighted simple return by (dt, bucket); without rets(ent, dt, ret), w has its rows' returns as `ret`, and nothing is joined."""
    if rets is None:
        rows = w.filter("ret IS NOT NULL")
    else:
        rows = w.select("ent", "dt", "bucket", "weight").join(rets.select("ent", "dt", "ret").filter("ret IS NOT NULL"), ["ent", "dt"])
    return rows.groupBy("dt", "bucket").agg(F.sum(F.col("weight") * F.col("ret")).alias("gross"), F.count("*").alias("n"))


def long_short(returns: DataFrame, top: int, bottom: int = 1) -> DataFrame:
    """The spread of the top over the bottom bucket, as bucket 0."""
    by = returns.groupBy("dt").agg(F.max(F.when(F.col("bucket") == top, F.col("gross"))).alias("a"), F.max(F.when(F.col("bucket") == bottom, F.col("gross"))).alias("b"))
    return by.filter("a IS NOT NULL AND b IS NOT NULL").select("dt", F.lit(0).alias("bucket"), (F.col("a") - F.col("b")).alias("gross"))


def turnover(w: DataFrame) -> DataFrame:
    """Half the sum of weight changes since the date before, over all holdings of either date; before the first date weights are 0."""
    dates = w.select("dt").distinct().withColumn("nxt", F.lead("dt").over(Window.orderBy("dt")))
    now = w.select("dt", "bucket", "ent", "weight")
    before = w.join(F.broadcast(dates), "dt").filter("nxt IS NOT NULL").select(F.col("nxt").alias("dt"), "bucket", "ent", F.col("weight").alias("was"))
    both = now.join(before, ["dt", "bucket", "ent"], "full_outer")
    return both.groupBy("dt", "bucket").agg((0.5 * F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).alias("turnover"))


def net_returns(gross: DataFrame, turn: DataFrame, bps: float = 20.0) -> DataFrame:
    rows = gross.join(turn, ["dt", "bucket"], "left").withColumn("turnover", F.coalesce("turnover", F.lit(0.0)))
    return rows.withColumn("net", F.col("gross") - F.col("turnover") * bps / 10_000)


def equity_curve(returns: DataFrame, col: str = "net") -> DataFrame:
    """Compounded by bucket; null from the first return of -1 or less on."""
    by = Window.partitionBy("bucket").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    dead = F.max(F.when(F.col(col) <= -1, 1).otherwise(0)).over(by)
    grown = F.exp(F.sum(F.log1p(F.when(F.col(col) > -1, F.col(col)))).over(by))
    return returns.withColumn("equity", F.when(dead == 0, grown))


def drawdown(curve: DataFrame) -> DataFrame:
    """equity over its running maximum, of 1 at least, less 1."""
    by = Window.partitionBy("bucket").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("drawdown", F.col("equity") / F.max(F.greatest(F.lit(1.0), F.col("equity"))).over(by) - 1)


def max_drawdown(falls: DataFrame) -> DataFrame:
    """Per bucket the deepest fall, its date, and the date of the peak before."""
    low = falls.groupBy("bucket").agg(F.min("drawdown").alias("max_drawdown"), F.min_by("dt", F.struct("drawdown", "dt")).alias("trough"))
    rows = falls.join(low, "bucket").filter((F.col("dt") <= F.col("trough")) & F.col("equity").isNotNull())
    peak = rows.groupBy("bucket").agg(F.max_by("dt", F.struct("equity", (-F.unix_date("dt")).alias("d"))).alias("peak"))
    return low.join(peak, "bucket", "left")


def performance(returns: DataFrame, col: str = "net", ppy: int = 52) -> DataFrame:
    by = returns.groupBy("bucket").agg(F.count(col).alias("n"), F.min(col).alias("worst"), F.sum(F.log1p(F.when(F.col(col) > -1, F.col(col)))).alias("g"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"), F.avg((F.col(col) > 0).cast("double")).alias("hit_rate"))
    return by.select("bucket", "n", F.when(F.col("worst") > -1, F.exp(F.col("g") * ppy / F.col("n")) - 1).alias("annual_return"), (F.col("sd") * ppy**0.5).alias("annual_vol"), F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * ppy**0.5).alias("sharpe"), "hit_rate")


def vs_benchmark(returns: DataFrame, market: DataFrame, col: str = "net", ppy: int = 52) -> DataFrame:
    """Alpha, beta, active return, tracking error and information ratio; market(dt, mret)."""
    rows = returns.join(market, "dt").filter("mret IS NOT NULL").withColumn("active", F.col(col) - F.col("mret"))
    by = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(col).alias("my"), F.avg("mret").alias("mx"), F.regr_sxx(col, "mret").alias("sxx"), F.regr_sxy(col, "mret").alias("sxy"), F.avg("active").alias("active"), F.stddev_samp("active").alias("sd"))
    beta = F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx"))
    return by.select("bucket", "n", (F.col("my") - beta * F.col("mx")).alias("alpha"), beta.alias("beta"), "active", (F.col("sd") * ppy**0.5).alias("tracking_error"), F.when(F.col("sd") > 0, F.col("active") / F.col("sd") * ppy**0.5).alias("information_ratio"))


def information_coefficient(signal: DataFrame, rets: DataFrame | None = None, spread: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Per date the rank correlation of score and return, with mid-ranks; without rets(ent, dt, ret), signal has its rows' returns as `ret`, and nothing is joined.

    `spread` as in bucket(), for dates of over `chunk` rows: rows equal in score and return are counted first, and the ranks' mean is known, so that counted rows need not be told apart again.
    """
    if rets is None:
        rows = signal.filter("ret IS NOT NULL").select("dt", quantised(F.col("score")).alias("score"), quantised(F.col("ret")).alias("ret"))
    else:
        rows = signal.select("ent", "dt", quantised(F.col("score")).alias("score")).join(rets.select("ent", "dt", quantised(F.col("ret")).alias("ret")).filter("ret IS NOT NULL"), ["ent", "dt"])
    if spread:
        counted = cut(rows.groupBy("dt", "score", "ret").agg(F.count("*").alias("_n")))
        ranked = mid_ranks(counted, ["dt"], {"score": "a", "ret": "b"}, "_n", "_all", chunk)
        a, b = (F.col(c) - (F.col("_all") + 1) / 2 for c in ("a", "b"))
        out = ranked.groupBy("dt").agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * a * b).alias("sxy"), F.sum(F.col("_n") * a * a).alias("sxx"), F.sum(F.col("_n") * b * b).alias("syy"))
    else:
        by = Window.partitionBy("dt")
        rank = lambda c: mid_rank(F.rank().over(by.orderBy(c)), F.count("*").over(Window.partitionBy("dt", c)))
        ranked = rows.select("dt", rank("score").alias("a"), rank("ret").alias("b"))
        out = ranked.groupBy("dt").agg(F.count("*").alias("n"), F.regr_sxy("a", "b").alias("sxy"), F.regr_sxx("a", "b").alias("sxx"), F.regr_syy("a", "b").alias("syy"))
    return out.select("dt", "n", F.when((F.col("sxx") > 0) & (F.col("syy") > 0), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))).alias("ic"))


def ic_summary(ic: DataFrame) -> DataFrame:
    by = ic.agg(F.count("ic").alias("n_dates"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("sd"))
    return by.withColumn("t", F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * F.sqrt("n_dates")))


def overlapping_portfolios(w: DataFrame, rets: DataFrame, periods: int = 4) -> DataFrame:
    """Each date's weights are held for `periods` bars; a date's return is the mean over the cohorts held. w(ent, bar, bucket, weight), rets(ent, dt, bar, ret)."""
    held = w.select("ent", F.col("bar").alias("formed"), "bucket", "weight", F.explode(F.sequence(F.col("bar"), F.col("bar") + periods - 1)).alias("bar"))
    rows = held.join(rets.select("ent", "bar", "dt", "ret").filter("ret IS NOT NULL"), ["ent", "bar"])
    cohort = rows.groupBy("dt", "bucket", (F.col("bar") - F.col("formed")).alias("age")).agg(F.sum(F.col("weight") * F.col("ret")).alias("r"))
    return cohort.groupBy("dt", "bucket").agg(F.avg("r").alias("gross"), F.count("*").alias("cohorts"))
