"""Registered queries: ingest of prices, event study, backtest, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplemark.functions.lineage import cut
from ripplemark.functions.numeric import quantised, rounded
from ripplemark.operators import backtest as bt
from ripplemark.operators import eventstudy as es
from ripplemark.operators import exposure as gx
from ripplemark.operators import ingest, kg, report
from ripplemark.plans import fixtures as fx
from ripplemark.plans.fixtures import VIEWS, sql

WINDOWS = [(-1, 1), (-5, 5), (0, 5)]
Q: dict[str, tuple] = {}


def q(x: str) -> str:
    return f"floor(({x}) * 1000000 + 0.5) / 1000000"


def query(name: str, oracle: str | None = None):
    def add(f):
        Q[name] = (f, oracle)
        return f

    return add


# ---- prices

@query("ing_normalise_prices", sql(f"SELECT ent, dt, {q('px')} AS px, vol FROM prices WHERE px > 0 AND vol >= 0", "prices"))
def _(s, d):
    p = fx.prices(s, d)
    return rounded(ingest.normalise_prices(p.union(p)), "px")


@query("ing_price_panel", sql(f"SELECT ent, dt, {q('px')} AS px, vol, bar FROM panel", "panel"))
def _(s, d):
    return rounded(fx.panel(s, d), "px")


@query("ing_price_panel_max_fill", sql(f"SELECT ent, dt, bar, CASE WHEN bar - seen_at <= 2 THEN {q('px')} END AS px FROM (SELECT p.*, max(CASE WHEN vol > 0 THEN bar END) OVER (PARTITION BY ent ORDER BY bar) AS seen_at FROM panel p)", "panel"))
def _(s, d):
    return rounded(ingest.price_panel(fx.prices(s, d), 2).drop("vol"), "px")


@query("ing_returns_log", sql(f"SELECT ent, dt, {q('ret')} AS ret FROM rets", "rets"))
def _(s, d):
    return rounded(fx.returns(s, d), "ret").select("ent", "dt", "ret")


@query("ing_returns_simple", sql(f"SELECT ent, dt, {q('ret')} AS ret FROM simple", "simple"))
def _(s, d):
    return rounded(fx.returns(s, d, "simple"), "ret").select("ent", "dt", "ret")


@query("ing_market_equal", sql(f"SELECT dt, {q('mret')} AS mret FROM market", "market"))
def _(s, d):
    return rounded(ingest.market_return(fx.returns(s, d)), "mret")


@query("ing_market_volume", sql(f"SELECT dt, {q('sum(ret * w) / sum(w)')} AS mret FROM (SELECT dt, ret, lag(vol) OVER (PARTITION BY ent ORDER BY dt) AS w FROM rets) WHERE ret IS NOT NULL AND w > 0 GROUP BY dt", "rets"))
def _(s, d):
    return rounded(ingest.market_return(fx.returns(s, d), "volume"), "mret")


@query("ing_market_benchmark", sql(f"SELECT dt, {q('ret')} AS mret FROM rets WHERE ent = 1", "rets"))
def _(s, d):
    return rounded(ingest.market_return(fx.returns(s, d), "entity", 1), "mret")


@query("ing_filing_asof", "WITH f AS (SELECT l_suppkey AS ent, l_orderkey AS filing_id, min(l_shipdate) AS filed_at FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2), r AS (SELECT DISTINCT l_suppkey AS ent, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS dt FROM lineitem) SELECT r.ent, r.dt, arg_max(f.filing_id, struct_pack(a := f.filed_at, b := f.filing_id)) AS filing_id, CAST(max(f.filed_at) AS DATE) AS filed_on FROM r LEFT JOIN f ON f.ent = r.ent AND f.filed_at < r.dt GROUP BY 1, 2")
def _(s, d):
    l = fx.table(s, d, "lineitem")
    f = l.filter("l_linenumber = 1").groupBy(F.col("l_suppkey").alias("ent"), F.col("l_orderkey").alias("filing_id")).agg(F.min("l_shipdate").alias("filed_at"))
    f = f.groupBy("ent", "filed_at").agg(F.max("filing_id").alias("filing_id"))
    r = l.select(F.col("l_suppkey").alias("ent"), F.date_trunc("quarter", "l_shipdate").cast("date").alias("dt")).distinct()
    return ingest.filing_asof(r, f).select("ent", "dt", "filing_id", F.col("filed_at").cast("date").alias("filed_on"))


# ---- event study

def aligned(s: SparkSession, d: str, weekly: DataFrame | None = None, panel: DataFrame | None = None) -> DataFrame:
    weekly = weekly or fx.bars(s, d)
    return es.align_events(fx.spikes(s, d, weekly), panel or fx.panel(s, d, weekly))


def windows(s: SparkSession, d: str, weekly: DataFrame | None = None) -> DataFrame:
    weekly = weekly or fx.bars(s, d)
    rets = cut(fx.returns(s, d, weekly=weekly).select("ent", "dt", "bar", "ret"))
    return es.event_windows(aligned(s, d, weekly, rets), rets, ingest.market_return(rets))


def abnormal(s: SparkSession, d: str, weekly: DataFrame | None = None) -> DataFrame:
    w = cut(windows(s, d, weekly))
    return es.abnormal_returns(w, es.fit_market_model(w))


def cars(s: SparkSession, d: str, weekly: DataFrame | None = None) -> DataFrame:
    return es.car(abnormal(s, d, weekly), WINDOWS)


@query("es_align_events", sql("SELECT event_id, ent, bar_dt, bar FROM aligned", "aligned"))
def _(s, d):
    return aligned(s, d).select("event_id", "ent", "bar_dt", "bar")


@query("es_event_windows", sql(f"SELECT event_id, ent, tau, {q('ret')} AS ret, {q('mret')} AS mret FROM win", "win"))
def _(s, d):
    return rounded(windows(s, d), "ret", "mret")


@query("es_drop_overlaps", "WITH RECURSIVE " + sql("", "aligned")[5:].rstrip() + ", k AS (SELECT ent, min(bar) AS bar FROM aligned GROUP BY ent UNION ALL SELECT k.ent, (SELECT min(a.bar) FROM aligned a WHERE a.ent = k.ent AND a.bar > k.bar + 5) FROM k WHERE k.bar IS NOT NULL) SELECT a.event_id, a.ent, a.bar FROM aligned a JOIN k ON k.ent = a.ent AND k.bar = a.bar")
def _(s, d):
    return es.drop_overlaps(aligned(s, d), 5).select("event_id", "ent", "bar")


@query("es_market_model", sql(f"SELECT event_id, ent, n, {q('alpha')} AS alpha, {q('beta')} AS beta, {q('s2')} AS s2 FROM fit", "fit"))
def _(s, d):
    return rounded(es.fit_market_model(windows(s, d)), "alpha", "beta", "s2")


@query("es_mean_model", sql(f"SELECT event_id, ent, count(*) AS n, {q('avg(ret)')} AS alpha, {q('var_samp(ret)')} AS s2 FROM win WHERE tau BETWEEN -60 AND -11 GROUP BY 1, 2 HAVING count(*) >= 50", "win"))
def _(s, d):
    return rounded(es.fit_mean_model(windows(s, d)).drop("beta"), "alpha", "s2")


@query("es_market_adjusted", sql(f"SELECT w.event_id, w.ent, w.tau, {q('w.ret - w.mret')} AS ar FROM win w JOIN fit f ON f.event_id = w.event_id AND f.ent = w.ent WHERE tau BETWEEN -5 AND 5", "win", "fit"))
def _(s, d):
    w = cut(windows(s, d))
    return rounded(es.abnormal_returns(w, es.market_adjusted(w)).select("event_id", "ent", "tau", "ar"), "ar")


@query("es_abnormal_returns", sql(f"SELECT event_id, ent, tau, {q('ar')} AS ar FROM ar", "ar"))
def _(s, d):
    return rounded(abnormal(s, d), "ar").select("event_id", "ent", "tau", "ar")


@query("es_car", sql(f"SELECT event_id, ent, t1, t2, {q('car')} AS car, {q('scar')} AS scar, n FROM car", "car"))
def _(s, d):
    return rounded(cars(s, d), "car", "scar").drop("n_est")


@query("es_aar_caar", sql(f"SELECT tau, n, {q('aar')} AS aar, {q('sum(aar) OVER (ORDER BY tau)')} AS caar FROM (SELECT tau, avg(ar) AS aar, count(*) AS n FROM ar GROUP BY tau)", "ar"))
def _(s, d):
    return rounded(es.aar_caar(abnormal(s, d)), "aar", "caar")


@query("es_car_tests", sql(f"SELECT t1, t2, count(*) AS n_events, {q('avg(car)')} AS mean_car, {q('avg(car) / (stddev_samp(car) / sqrt(count(*)))')} AS t_cross, {q('sum(scar) / sqrt(sum(CASE WHEN scar IS NOT NULL THEN CAST(n_est - 2 AS DOUBLE) / (n_est - 4) END))')} AS patell_z, {q('avg(scar) / (stddev_samp(scar) / sqrt(count(scar)))')} AS bmp_t, {q('avg(CASE WHEN car > 0 THEN 1.0 ELSE 0.0 END)')} AS positive, {q('(avg(CASE WHEN car > 0 THEN 1.0 ELSE 0.0 END) - 0.5) * sqrt(count(*)) / 0.5')} AS sign_z FROM car GROUP BY 1, 2", "car"))
def _(s, d):
    return rounded(es.car_tests(cars(s, d)), "mean_car", "t_cross", "patell_z", "bmp_t", "positive", "sign_z")


@query("es_rank_test", sql(f"SELECT {q('max(CASE WHEN tau = 0 THEN u END)')} AS u0, {q('sqrt(avg(u * u))')} AS sd, count(*) AS n_taus, {q('max(CASE WHEN tau = 0 THEN u END) / sqrt(avg(u * u))')} AS z FROM (SELECT tau, avg((k + (ties - 1) / 2.0) / (l + 1) - 0.5) AS u FROM (SELECT tau, rank() OVER (PARTITION BY event_id, ent ORDER BY ar) AS k, count(*) OVER (PARTITION BY event_id, ent, ar) AS ties, count(*) OVER (PARTITION BY event_id, ent) AS l FROM (SELECT w.event_id, w.ent, w.tau, {q('w.ret - (f.alpha + f.beta * w.mret)')} AS ar FROM win w JOIN fit f ON f.event_id = w.event_id AND f.ent = w.ent WHERE w.tau BETWEEN -60 AND -11 OR w.tau BETWEEN -5 AND 5)) GROUP BY tau)", "win", "fit"))
def _(s, d):
    w = cut(windows(s, d))
    return rounded(es.rank_test(w, es.fit_market_model(w)), "u0", "sd", "z")


EXPOSURE = f"SELECT c.event_id, c.ent, c.t1, c.t2, c.car, 'weighted_degree' AS measure, {q('g.g')} AS score FROM car c JOIN (SELECT src, sum(w) AS g FROM sym GROUP BY src) g ON g.src = 'S' || c.ent"


def degrees(s: SparkSession, d: str) -> DataFrame:
    return gx.degree_centrality(kg.symmetrise(cut(kg.kg_edges(fx.seed_edges(s, d)))))


def exposed(s: SparkSession, d: str, c: DataFrame) -> DataFrame:
    score = degrees(s, d).filter("node LIKE 'S%'").select(F.expr("cast(substr(node, 2) AS bigint)").alias("ent"), quantised(F.col("weighted") / 2).alias("score"))
    return c.select("event_id", "ent").distinct().join(score, "ent").withColumn("measure", F.lit("weighted_degree"))


@query("es_car_by_exposure", sql(f"SELECT measure, t1, t2, bucket, {q('avg(car)')} AS mean_car, count(*) AS n, {q('avg(car) / (stddev_samp(car) / sqrt(count(*)))')} AS t FROM (SELECT *, ntile(5) OVER (PARTITION BY measure, t1, t2 ORDER BY score, event_id, ent) AS bucket FROM ({EXPOSURE})) GROUP BY 1, 2, 3, 4", "car", "sym"))
def _(s, d):
    c = cut(cars(s, d))
    return rounded(es.car_by_exposure(c, exposed(s, d, c)), "mean_car", "t")


@query("es_exposure_regression", sql(f"SELECT measure, t1, t2, n, {q('b')} AS slope, {q('my - b * mx')} AS intercept, {q('sxy * sxy / (sxx * syy)')} AS r2, {q('b / sqrt((syy - b * sxy) / (n - 2) / sxx)')} AS t FROM (SELECT *, sxy / sxx AS b FROM (SELECT measure, t1, t2, count(*) AS n, avg(car) AS my, avg(score) AS mx, regr_sxx(car, score) AS sxx, regr_syy(car, score) AS syy, regr_sxy(car, score) AS sxy FROM ({EXPOSURE}) GROUP BY 1, 2, 3))", "car", "sym"))
def _(s, d):
    c = cut(cars(s, d))
    return rounded(es.exposure_regression(c, exposed(s, d, c)), "slope", "intercept", "r2", "t")


@query("x_buy_and_hold", sql(f"SELECT event_id, ent, {q('exp(sum(ln(1 + sret))) - exp(sum(ln(1 + smret)))')} AS bhar, count(*) AS n FROM (SELECT event_id, ent, exp(ret) - 1 AS sret, exp(mret) - 1 AS smret FROM win WHERE tau BETWEEN -5 AND 5) GROUP BY 1, 2", "win"))
def _(s, d):
    w = windows(s, d).filter(F.col("tau").between(-5, 5))
    held = lambda c: F.exp(F.sum(F.log1p(F.exp(c) - 1)))
    return rounded(w.groupBy("event_id", "ent").agg((held("ret") - held("mret")).alias("bhar"), F.count("*").alias("n")), "bhar")


# ---- backtest: momentum over 4 bars, known a bar before

VIEWS.update(
    {
        "signal": (("panel",), "SELECT ent, dt, bar, vol, lag(mom) OVER (PARTITION BY ent ORDER BY bar) AS score FROM (SELECT ent, dt, bar, vol, px / lag(px, 4) OVER (PARTITION BY ent ORDER BY bar) - 1 AS mom FROM panel)"),
        "buckets": (("signal",), f"SELECT ent, dt, bar, vol, score, ntile(5) OVER (PARTITION BY dt ORDER BY {q('score')}, ent) AS bucket FROM signal WHERE score IS NOT NULL"),
        "weights": (("buckets",), "SELECT ent, dt, bar, bucket, 1.0 / count(*) OVER (PARTITION BY dt, bucket) AS weight FROM buckets"),
        "gross": (("weights", "simple"), "SELECT w.dt, w.bucket, sum(w.weight * r.ret) AS gross, count(*) AS n FROM weights w JOIN simple r ON r.ent = w.ent AND r.dt = w.dt WHERE r.ret IS NOT NULL GROUP BY 1, 2"),
        "turn": (("weights",), "SELECT coalesce(n.dt, b.dt) AS dt, coalesce(n.bucket, b.bucket) AS bucket, 0.5 * sum(abs(coalesce(n.weight, 0) - coalesce(b.weight, 0))) AS turnover FROM weights n FULL OUTER JOIN (SELECT x.nxt AS dt, w.bucket, w.ent, w.weight FROM weights w JOIN (SELECT dt, lead(dt) OVER (ORDER BY dt) AS nxt FROM (SELECT DISTINCT dt FROM weights)) x ON x.dt = w.dt WHERE x.nxt IS NOT NULL) b ON b.dt = n.dt AND b.bucket = n.bucket AND b.ent = n.ent GROUP BY 1, 2"),
        "net": (("gross", "turn"), "SELECT g.dt, g.bucket, g.gross, coalesce(t.turnover, 0) AS turnover, g.gross - coalesce(t.turnover, 0) * 20 / 10000 AS net FROM gross g LEFT JOIN turn t ON t.dt = g.dt AND t.bucket = g.bucket"),
        "curve": (("net",), "SELECT dt, bucket, net, CASE WHEN max(CASE WHEN net <= -1 THEN 1 ELSE 0 END) OVER o = 0 THEN exp(sum(CASE WHEN net > -1 THEN ln(1 + net) END) OVER o) END AS equity FROM net WINDOW o AS (PARTITION BY bucket ORDER BY dt)"),
        "falls": (("curve",), "SELECT dt, bucket, equity, equity / max(greatest(1.0, equity)) OVER (PARTITION BY bucket ORDER BY dt) - 1 AS drawdown FROM curve"),
    }
)


def signal(s: SparkSession, d: str, panel: DataFrame | None = None) -> DataFrame:
    p = panel or fx.panel(s, d)
    return bt.lag_signal(p.withColumn("score", F.col("px") / F.lag("px", 4).over(Window.partitionBy("ent").orderBy("bar")) - 1), 1)


def weighted(s: SparkSession, d: str, how: str = "equal", panel: DataFrame | None = None) -> DataFrame:
    return bt.weights(bt.bucket(signal(s, d, panel)), how)


def gross(s: SparkSession, d: str) -> DataFrame:
    p = cut(ingest.returns(fx.panel(s, d), "simple"))
    return bt.portfolio_returns(weighted(s, d, panel=p))


def net(s: SparkSession, d: str, panel: DataFrame | None = None) -> DataFrame:
    """panel: with simple returns, written."""
    p = panel or cut(ingest.returns(fx.panel(s, d), "simple"))
    w = cut(weighted(s, d, panel=p).select("ent", "dt", "bucket", "weight", "ret"))
    return bt.net_returns(bt.portfolio_returns(w), bt.turnover(w))


@query("bt_lag_signal", sql(f"SELECT ent, dt, {q('score')} AS score FROM signal WHERE score IS NOT NULL", "signal"))
def _(s, d):
    return rounded(signal(s, d), "score").select("ent", "dt", "score")


@query("bt_rebalance_dates", sql("SELECT CAST(date_trunc('month', dt) AS DATE) AS period, min(dt) AS dt FROM panel GROUP BY 1", "panel"))
def _(s, d):
    return bt.rebalance_dates(fx.panel(s, d))


@query("bt_bucket", sql("SELECT ent, dt, bucket FROM buckets", "buckets"))
def _(s, d):
    return bt.bucket(signal(s, d)).select("ent", "dt", "bucket")


@query("bt_bucket_spread", sql("SELECT ent, dt, bucket FROM buckets", "buckets"))
def _(s, d):
    return bt.bucket(signal(s, d), spread=True).select("ent", "dt", "bucket")


@query("bt_weights_equal", sql(f"SELECT ent, dt, bucket, {q('weight')} AS weight FROM weights", "weights"))
def _(s, d):
    return rounded(weighted(s, d), "weight").select("ent", "dt", "bucket", "weight")


@query("bt_weights_volume", sql(f"SELECT ent, dt, bucket, {q('vol / t')} AS weight FROM (SELECT *, sum(vol) OVER (PARTITION BY dt, bucket) AS t FROM buckets) WHERE t > 0", "buckets"))
def _(s, d):
    return rounded(weighted(s, d, "volume"), "weight").select("ent", "dt", "bucket", "weight")


@query("bt_portfolio_returns", sql(f"SELECT dt, bucket, {q('gross')} AS gross, n FROM gross", "gross"))
def _(s, d):
    return rounded(gross(s, d), "gross")


@query("bt_long_short", sql(f"SELECT a.dt, 0 AS bucket, {q('a.gross - b.gross')} AS gross FROM gross a JOIN gross b ON a.dt = b.dt AND a.bucket = 5 AND b.bucket = 1", "gross"))
def _(s, d):
    return rounded(bt.long_short(gross(s, d), 5), "gross")


@query("bt_turnover", sql(f"SELECT dt, bucket, {q('turnover')} AS turnover FROM turn", "turn"))
def _(s, d):
    return rounded(bt.turnover(cut(weighted(s, d))), "turnover")


@query("bt_net_returns", sql(f"SELECT dt, bucket, {q('turnover')} AS turnover, {q('net')} AS net FROM net", "net"))
def _(s, d):
    return rounded(net(s, d), "turnover", "net").select("dt", "bucket", "turnover", "net")


@query("bt_equity_curve", sql("SELECT dt, bucket, floor(ln(equity) * 1000 + 0.5) / 1000 AS log_equity FROM curve", "curve"))
def _(s, d):
    return bt.equity_curve(net(s, d)).select("dt", "bucket", quantised(F.log("equity"), 3).alias("log_equity"))


@query("bt_drawdown", sql(f"SELECT dt, bucket, {q('drawdown')} AS drawdown FROM falls", "falls"))
def _(s, d):
    return rounded(bt.drawdown(bt.equity_curve(net(s, d))), "drawdown").select("dt", "bucket", "drawdown")


@query("bt_max_drawdown", sql(f"SELECT bucket, {q('min(drawdown)')} AS max_drawdown FROM falls GROUP BY 1", "falls"))
def _(s, d):
    return rounded(bt.max_drawdown(cut(bt.drawdown(bt.equity_curve(net(s, d))))), "max_drawdown").select("bucket", "max_drawdown")


@query("bt_performance", sql(f"SELECT bucket, count(net) AS n, CASE WHEN min(net) > -1 THEN {q('sum(CASE WHEN net > -1 THEN ln(1 + net) END) * 52 / count(net)')} END AS log_annual_return, {q('stddev_samp(net) * sqrt(52.0)')} AS annual_vol, {q('avg(net) / stddev_samp(net) * sqrt(52.0)')} AS sharpe, {q('avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END)')} AS hit_rate FROM net GROUP BY 1", "net"))
def _(s, d):
    out = bt.performance(net(s, d)).withColumn("log_annual_return", F.log1p("annual_return")).drop("annual_return")
    return rounded(out, "log_annual_return", "annual_vol", "sharpe", "hit_rate")


@query("bt_vs_benchmark", sql(f"SELECT bucket, n, {q('my - sxy / sxx * mx')} AS alpha, {q('sxy / sxx')} AS beta, {q('active')} AS active, {q('sd * sqrt(52.0)')} AS tracking_error, {q('active / sd * sqrt(52.0)')} AS information_ratio FROM (SELECT bucket, count(*) AS n, avg(net) AS my, avg(mret) AS mx, regr_sxx(net, mret) AS sxx, regr_sxy(net, mret) AS sxy, avg(net - mret) AS active, stddev_samp(net - mret) AS sd FROM net JOIN (SELECT dt, avg(ret) AS mret FROM simple GROUP BY dt) m USING (dt) WHERE mret IS NOT NULL GROUP BY bucket)", "net", "simple"))
def _(s, d):
    p = cut(ingest.returns(fx.panel(s, d), "simple"))
    m = ingest.market_return(p)
    return rounded(bt.vs_benchmark(net(s, d, p), m), "alpha", "beta", "active", "tracking_error", "information_ratio")


def scored(s: SparkSession, d: str) -> DataFrame:
    """Signals with their bars' simple returns, from one shuffle by entity."""
    return signal(s, d, ingest.returns(fx.panel(s, d), "simple"))


IC = f"SELECT dt, count(*) AS n, regr_sxy(a, b) / sqrt(regr_sxx(a, b) * regr_syy(a, b)) AS ic, regr_sxx(a, b) AS sxx, regr_syy(a, b) AS syy FROM (SELECT dt, rank() OVER (PARTITION BY dt ORDER BY score) + (count(*) OVER (PARTITION BY dt, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY dt ORDER BY ret) + (count(*) OVER (PARTITION BY dt, ret) - 1) / 2.0 AS b FROM (SELECT g.ent, g.dt, {q('g.score')} AS score, {q('r.ret')} AS ret FROM signal g JOIN simple r ON r.ent = g.ent AND r.dt = g.dt WHERE g.score IS NOT NULL AND r.ret IS NOT NULL)) GROUP BY dt"


@query("bt_information_coefficient", sql(f"SELECT dt, n, CASE WHEN sxx > 0 AND syy > 0 THEN {q('ic')} END AS ic FROM ({IC})", "signal", "simple"))
def _(s, d):
    return rounded(bt.information_coefficient(scored(s, d)), "ic")


@query("bt_information_coefficient_spread", Q["bt_information_coefficient"][1])
def _(s, d):
    return rounded(bt.information_coefficient(scored(s, d), spread=True), "ic")


@query("bt_ic_summary", sql(f"SELECT count(ic) AS n_dates, {q('avg(ic)')} AS mean, {q('stddev_samp(ic)')} AS sd, {q('avg(ic) / stddev_samp(ic) * sqrt(count(ic))')} AS t FROM (SELECT CASE WHEN sxx > 0 AND syy > 0 THEN ic END AS ic FROM ({IC}))", "signal", "simple"))
def _(s, d):
    return rounded(bt.ic_summary(bt.information_coefficient(scored(s, d))), "mean", "sd", "t")


@query("x_overlapping_portfolios", sql(f"SELECT dt, bucket, {q('avg(r)')} AS gross, count(*) AS cohorts FROM (SELECT r.dt, w.bucket, r.bar - w.bar AS age, sum(w.weight * r.ret) AS r FROM weights w JOIN simple r ON r.ent = w.ent AND r.bar BETWEEN w.bar AND w.bar + 3 WHERE r.ret IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2", "weights", "simple"))
def _(s, d):
    p = cut(fx.panel(s, d))
    return rounded(bt.overlapping_portfolios(weighted(s, d, panel=p), ingest.returns(p, "simple"), 4), "gross")


# ---- reports

@query("rp_stage_summary", sql("SELECT 'bars' AS stage, count(*) AS rows, count(DISTINCT ent) AS entities, min(dt) AS first, max(dt) AS last, 'pass' AS verdict FROM prices UNION ALL SELECT 'panel', count(*), count(DISTINCT ent), min(dt), max(dt), 'pass' FROM panel UNION ALL SELECT 'events', count(*), count(DISTINCT ent), min(dt), max(dt), 'pass' FROM spikes", "prices", "panel", "spikes"))
def _(s, d):
    w = fx.bars(s, d)
    return report.stage_summary({"bars": (fx.prices(s, d, w), "ent", "dt"), "panel": (fx.panel(s, d, w), "ent", "dt"), "events": (fx.spikes(s, d, w), "ent", "dt")})


@query("rp_top_exposed", sql(f"SELECT e.event_id, e.ent, e.score, e.rnk, {q('c.car')} AS car FROM (SELECT * FROM (SELECT country AS event_id, ent, score, row_number() OVER (PARTITION BY country ORDER BY score DESC, ent) AS rnk FROM universe u JOIN (SELECT src, {q('sum(w)')} AS score FROM sym GROUP BY src) g ON g.src = 'S' || u.ent) WHERE rnk <= 3) e LEFT JOIN (SELECT ent, avg(car) AS car FROM car WHERE t1 = -1 GROUP BY ent) c ON c.ent = e.ent", "universe", "sym", "car"))
def _(s, d):
    u = fx.universe(s, d).select("ent", F.col("country").alias("event_id"))
    score = degrees(s, d).filter("node LIKE 'S%'").select(F.expr("cast(substr(node, 2) AS bigint)").alias("ent"), quantised(F.col("weighted") / 2).alias("score"))
    c = cars(s, d).filter("t1 = -1").groupBy("ent").agg(F.avg("car").alias("car"))
    return rounded(report.top_exposed(u.join(score, "ent"), u.join(c, "ent").select("event_id", "ent", "car"), 3), "car")


@query("rp_rollup", sql(f"SELECT sector, year, {q('avg(car)')} AS mean_car, count(*) AS n, CAST(GROUPING(sector) * 2 + GROUPING(year) AS INTEGER) AS level FROM (SELECT u.sector, CAST(year(a.bar_dt) AS INTEGER) AS year, c.car FROM car c JOIN aligned a ON a.event_id = c.event_id AND a.ent = c.ent JOIN universe u ON u.ent = c.ent WHERE c.t1 = -1) GROUP BY ROLLUP (sector, year)", "car", "aligned", "universe"))
def _(s, d):
    weekly = fx.bars(s, d)
    c = cars(s, d, weekly).filter("t1 = -1").join(aligned(s, d, weekly).select("event_id", "ent", F.col("bar_dt").alias("dt")), ["event_id", "ent"])
    return rounded(report.rollup_report(c, fx.universe(s, d)), "mean_car")
