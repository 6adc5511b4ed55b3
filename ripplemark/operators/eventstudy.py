"""Event study: alignment, windows, models of expected return, abnormal returns and their tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.functions.lineage import cut
from ripplemark.functions.numeric import mid_rank
from ripplemark.functions.ranges import binned, range_join
from ripplemark.functions.ranking import ntiles

ESTIMATION, EVENT, LEAST = (-60, -11), (-5, 5), 50


def align_events(events: DataFrame, panel: DataFrame, most_days: int = 14) -> DataFrame:
    """The first bar on or after each event's date, at most most_days later; bars and events meet in bins of days."""
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    p = panel.select("ent", F.col("dt").alias("bar_dt"), "bar", day("dt").alias("_day"))
    e = events.withColumns({"_low": day("dt"), "_high": day("dt") + most_days})
    return range_join(p, ["ent"], "_day", e, "_low", "_high", most_days + 1).groupBy("event_id", "ent", "dt").agg(F.min("bar_dt").alias("bar_dt"), F.min("bar").alias("bar"))


def event_windows(aligned: DataFrame, rets: DataFrame, market: DataFrame, low: int = ESTIMATION[0], high: int = EVENT[1]) -> DataFrame:
    """Rows (event_id, ent, tau, ret, mret): the bars from low to high around each event, met in bins of bars."""
    r = rets.filter("ret IS NOT NULL").select("ent", F.col("dt").alias("_d"), F.col("bar").alias("_b"), "ret")
    e = aligned.select("event_id", "ent", "bar", (F.col("bar") + low).alias("_low"), (F.col("bar") + high).alias("_high"))
    rows = range_join(r, ["ent"], "_b", e, "_low", "_high", high - low + 1)
    return rows.join(market.select(F.col("dt").alias("_d"), "mret"), "_d").select("event_id", "ent", (F.col("_b") - F.col("bar")).alias("tau"), "ret", "mret")


def drop_overlaps(aligned: DataFrame, gap: int = 5, width: int = 4096) -> DataFrame:
    """Per entity in order of bars, an event within `gap` bars of the last one kept goes.

    A bar with none in the `gap` bars before it is kept.  From a kept bar the
    first one over `gap` later is kept too: if it is over 2 * gap later, the one
    before is more than `gap` away and it is kept anyway, so that a pointer looks
    no farther.  What the pointers reach from the first kind is found by
    doubling them.  Bars are cut into bins of `width` bars that overlap by the
    pointers' reach, so that an entity with many events is many tasks.
    """
    if gap < 1:
        return aligned
    reach, width = 2 * gap, max(width, 4 * gap)
    bars = aligned.select("ent", F.col("bar").cast("long").alias("bar")).distinct()
    _, own = binned(bars, "bar", bars, F.col("bar") - reach, F.col("bar") + reach, width)
    by = Window.partitionBy("ent", "_bin").orderBy("bar")
    first = F.max("bar").over(by.rangeBetween(-gap, -1)).isNull()
    behind = F.min("bar").over(by.rangeBetween(gap + 1, reach))
    links = cut(own.withColumns({"first": first, "next": behind}).filter(F.floor(F.col("bar") / width) == F.col("_bin")).select("ent", "bar", "first", "next"))
    kept, jump = links.filter("first").select("ent", "bar"), links.filter("next IS NOT NULL").select("ent", "bar", "next")
    while not jump.isEmpty():
        step = kept.join(jump, ["ent", "bar"]).select("ent", F.col("next").alias("bar"))
        kept = cut(kept.union(step).distinct())
        far = jump.select("ent", F.col("bar").alias("next"), F.col("next").alias("_far"))
        jump = cut(jump.join(far, ["ent", "next"]).select("ent", "bar", F.col("_far").alias("next")))
    return aligned.join(kept, ["ent", "bar"], "left_semi")


def fit_market_model(windows: DataFrame, low: int = ESTIMATION[0], high: int = ESTIMATION[1], least: int = LEAST) -> DataFrame:
    """OLS of ret on mret over the estimation rows; s2 is the residual variance."""
    f = windows.filter(F.col("tau").between(low, high)).groupBy("event_id", "ent").agg(F.count("*").alias("n"), F.avg("ret").alias("my"), F.avg("mret").alias("mx"), F.regr_sxx("ret", "mret").alias("sxx"), F.regr_syy("ret", "mret").alias("syy"), F.regr_sxy("ret", "mret").alias("sxy"))
    f = f.filter(F.col("n") >= least).withColumn("beta", F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx")))
    return f.select("event_id", "ent", "n", "beta", (F.col("my") - F.col("beta") * F.col("mx")).alias("alpha"), F.when(F.col("sxx") > 0, (F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("n") - 2)).alias("s2"))


def fit_mean_model(windows: DataFrame, low: int = ESTIMATION[0], high: int = ESTIMATION[1], least: int = LEAST) -> DataFrame:
    """Expected return is the mean of the estimation rows: alpha is the mean and beta 0."""
    f = windows.filter(F.col("tau").between(low, high)).groupBy("event_id", "ent").agg(F.count("*").alias("n"), F.avg("ret").alias("alpha"), F.var_samp("ret").alias("s2"))
    return f.filter(F.col("n") >= least).select("event_id", "ent", "n", F.lit(0.0).alias("beta"), "alpha", "s2")


def market_adjusted(windows: DataFrame, low: int = ESTIMATION[0], high: int = ESTIMATION[1], least: int = LEAST) -> DataFrame:
    """Expected return is the market's: alpha 0 and beta 1."""
    f = windows.filter(F.col("tau").between(low, high)).groupBy("event_id", "ent").agg(F.count("*").alias("n"), F.var_samp(F.col("ret") - F.col("mret")).alias("s2"))
    return f.filter(F.col("n") >= least).select("event_id", "ent", "n", F.lit(1.0).alias("beta"), F.lit(0.0).alias("alpha"), "s2")


def abnormal_returns(windows: DataFrame, fit: DataFrame, low: int = EVENT[0], high: int = EVENT[1]) -> DataFrame:
    f = fit.select("event_id", "ent", "alpha", "beta", "s2", F.col("n").alias("n_est"))
    return windows.filter(F.col("tau").between(low, high)).join(f, ["event_id", "ent"]).select("event_id", "ent", "tau", (F.col("ret") - (F.col("alpha") + F.col("beta") * F.col("mret"))).alias("ar"), "s2", "n_est")


def car(ar: DataFrame, windows: list[tuple[int, int]]) -> DataFrame:
    """Cumulative and standardised abnormal return over several windows at once."""
    spans = F.array(*[F.struct(F.lit(a).alias("t1"), F.lit(b).alias("t2")) for a, b in windows])
    rows = ar.select("*", F.explode(F.filter(spans, lambda s: (F.col("tau") >= s["t1"]) & (F.col("tau") <= s["t2"]))).alias("_w"))
    out = rows.groupBy("event_id", "ent", "_w.t1", "_w.t2").agg(F.sum("ar").alias("car"), F.max("s2").alias("s2"), F.count("*").alias("n"), F.max("n_est").alias("n_est"))
    return out.withColumn("scar", F.when(F.col("s2") >= 1e-12, F.col("car") / (F.sqrt("s2") * F.sqrt("n")))).drop("s2")


def aar_caar(ar: DataFrame) -> DataFrame:
    """Mean abnormal return for each tau, and its running sum; there are as few rows as taus."""
    by = ar.groupBy("tau").agg(F.avg("ar").alias("aar"), F.count("*").alias("n"))
    return by.withColumn("caar", F.sum("aar").over(Window.orderBy("tau").rowsBetween(Window.unboundedPreceding, 0)))


def car_tests(cars: DataFrame) -> DataFrame:
    """Per window: cross-section t, Patell Z, BMP t, and the sign test."""
    by = cars.groupBy("t1", "t2").agg(F.count("*").alias("n_events"), F.avg("car").alias("mean_car"), F.stddev_samp("car").alias("sd"), F.sum("scar").alias("sum_scar"), F.avg("scar").alias("mean_scar"), F.stddev_samp("scar").alias("sd_scar"), F.count("scar").alias("n_scar"), F.sum(F.when(F.col("scar").isNotNull(), (F.col("n_est") - 2) / (F.col("n_est") - 4))).alias("v"), F.avg((F.col("car") > 0).cast("double")).alias("positive"))
    return by.select("t1", "t2", "n_events", "mean_car", F.when(F.col("sd") > 0, F.col("mean_car") / (F.col("sd") / F.sqrt("n_events"))).alias("t_cross"), F.when(F.col("v") > 0, F.col("sum_scar") / F.sqrt("v")).alias("patell_z"), F.when(F.col("sd_scar") > 0, F.col("mean_scar") / (F.col("sd_scar") / F.sqrt("n_scar"))).alias("bmp_t"), "positive", ((F.col("positive") - 0.5) * F.sqrt("n_events") / 0.5).alias("sign_z"))


def rank_test(windows: DataFrame, fit: DataFrame, low: int = ESTIMATION[0], high: int = EVENT[1]) -> DataFrame:
    """Corrado's rank test: mid-ranks of all abnormal returns of an event, over estimation and event rows."""
    ar = abnormal_returns(windows, fit, low, high).filter(F.col("tau").between(*ESTIMATION) | F.col("tau").between(*EVENT))
    by = Window.partitionBy("event_id", "ent")
    k = mid_rank(F.rank().over(by.orderBy("ar")), F.count("*").over(Window.partitionBy("event_id", "ent", "ar")))
    u = ar.select("tau", (k / (F.count("*").over(by) + 1) - 0.5).alias("u")).groupBy("tau").agg(F.avg("u").alias("u"))
    return u.agg(F.max(F.when(F.col("tau") == 0, F.col("u"))).alias("u0"), F.sqrt(F.avg(F.col("u") * F.col("u"))).alias("sd"), F.count("*").alias("n_taus")).withColumn("z", F.when(F.col("sd") > 0, F.col("u0") / F.col("sd")))


def car_by_exposure(cars: DataFrame, exposure: DataFrame, q: int = 5) -> DataFrame:
    """Mean CAR by bucket of exposure; exposure(event_id, ent, measure, score)."""
    rows = cut(cars.join(exposure, ["event_id", "ent"]))
    rows = ntiles(rows, ["measure", "t1", "t2"], ["score", "event_id", "ent"], q)
    by = rows.groupBy("measure", "t1", "t2", "bucket").agg(F.avg("car").alias("mean_car"), F.count("*").alias("n"), F.stddev_samp("car").alias("sd"))
    return by.withColumn("t", F.when(F.col("sd") > 0, F.col("mean_car") / (F.col("sd") / F.sqrt("n")))).drop("sd")


def exposure_regression(cars: DataFrame, exposure: DataFrame) -> DataFrame:
    """Per measure and window: CAR regressed on the score."""
    by = cars.join(exposure, ["event_id", "ent"]).groupBy("measure", "t1", "t2").agg(F.count("*").alias("n"), F.avg("car").alias("my"), F.avg("score").alias("mx"), F.regr_sxx("car", "score").alias("sxx"), F.regr_syy("car", "score").alias("syy"), F.regr_sxy("car", "score").alias("sxy"))
    by = by.withColumn("slope", F.when(F.col("sxx") > 1e-12, F.col("sxy") / F.col("sxx"))).withColumn("r2", F.when((F.col("sxx") > 1e-12) & (F.col("syy") > 1e-12), F.col("sxy") * F.col("sxy") / (F.col("sxx") * F.col("syy"))))
    s2 = (F.col("syy") - F.col("slope") * F.col("sxy")) / (F.col("n") - 2)
    return by.select("measure", "t1", "t2", "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "r2", F.when((F.col("n") > 2) & (s2 > 1e-12), F.col("slope") / F.sqrt(s2 / F.col("sxx"))).alias("t"))
