"""The inputs of the risk operators, derived from the given tables, and the same views as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.functions.lineage import cut
from ripplemark.functions.numeric import tokens
from ripplemark.operators import ingest

KEYWORDS = (("worthless", "1.0"), ("disgusting", "0.8"), ("pathetic", "0.5"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars: an entity is a supplier, its price what a unit cost on average; `back` is the quantity returned. Written once, so that all that derives from them scans lineitem once."""
    week = F.trunc("l_shipdate", "week")
    paid = F.sum(F.floor(F.col("l_extendedprice").cast("double") * 100 + 0.5)) / 100  # whole cents: an exact sum of 8 bytes
    back = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0))
    return cut(table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ent"), week.alias("dt")).agg((paid / F.sum("l_quantity")).alias("px"), F.sum("l_quantity").alias("vol"), back.alias("back")))


def prices(spark: SparkSession, sf_dir: str, weekly: DataFrame | None = None) -> DataFrame:
    return (weekly or bars(spark, sf_dir)).select("ent", "dt", "px", "vol")


def panel(spark: SparkSession, sf_dir: str, weekly: DataFrame | None = None) -> DataFrame:
    return ingest.price_panel(prices(spark, sf_dir, weekly))


def returns(spark: SparkSession, sf_dir: str, kind: str = "log", weekly: DataFrame | None = None) -> DataFrame:
    return ingest.returns(panel(spark, sf_dir, weekly), kind)


def spikes(spark: SparkSession, sf_dir: str, weekly: DataFrame | None = None) -> DataFrame:
    """Events: weeks in which over 0.8 of an entity's quantity, of 100 or more, was returned."""
    by = (weekly or bars(spark, sf_dir)).filter((F.col("vol") >= 100) & (F.col("back") > 0.8 * F.col("vol")))
    return by.select(F.concat_ws("-", "ent", F.date_format("dt", "yyyyMMdd")).alias("event_id"), "ent", "dt")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    day = F.expr("date_add(DATE'1995-01-02', cast(doc_id * 37 % 2400 as int))")
    return d.select(F.col("doc_id").alias("article_id"), day.alias("published_at"), F.concat(F.lit("http://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("domain"), "lang", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "text")


def keywords(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    return spark.createDataFrame([(k, "abuse", w) for k, w in KEYWORDS], "keyword string, category string, w string").select("keyword", "category", F.col("w").cast("decimal(9,4)").alias("weight"))


def alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th of the long words that 2 to 50 articles hold names the k-th supplier."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("alias")).filter((F.length("alias") >= 9) & ~F.col("alias").isin([k for k, _ in KEYWORDS]))
    n = table(spark, sf_dir, "supplier").count()
    top = words.groupBy("alias").agg(F.count("*").alias("n")).filter("n BETWEEN 2 AND 50").orderBy(F.desc("n"), "alias").limit(n)
    from pyspark.sql import Window

    return top.select("alias", F.row_number().over(Window.orderBy(F.desc("n"), "alias")).cast("long").alias("ent"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("ent"), F.col("s_name").alias("name"), F.col("r_name").alias("sector"), F.col("n_name").alias("country"))


def seed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in nations in regions, with their three main brands and the customers that buy from them most."""
    from pyspark.sql import Window

    s, n, l, p, o = (table(spark, sf_dir, x) for x in ("supplier", "nation", "lineitem", "part", "orders"))
    located = s.select(F.concat(F.lit("S"), "s_suppkey").alias("src"), F.concat(F.lit("N"), "s_nationkey").alias("dst"), F.lit("LOCATED_IN").alias("rel"), F.lit(1.0).alias("w"))
    within = n.select(F.concat(F.lit("N"), "n_nationkey").alias("src"), F.concat(F.lit("R"), "n_regionkey").alias("dst"), F.lit("IN_REGION").alias("rel"), F.lit(1.0).alias("w"))

    def share(rows: DataFrame, key: str, other: str, top: int) -> DataFrame:
        q = rows.groupBy(key, other).agg(F.sum("l_quantity").alias("q"))
        by = Window.partitionBy(key)
        q = q.withColumn("total", F.sum("q").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.desc("q"), other)))
        return q.filter(F.col("r") <= top).withColumn("w", F.col("q") / F.col("total"))

    brand = share(l.join(p, l.l_partkey == p.p_partkey).select("l_suppkey", "p_brand", "l_quantity"), "l_suppkey", "p_brand", 3)
    # few rows share customer and supplier, so that sums before the shuffle would save nothing: one shuffle by customer serves sums and ranks
    buyer = share(l.join(o, l.l_orderkey == o.o_orderkey).select("o_custkey", "l_suppkey", "l_quantity").repartition("o_custkey"), "o_custkey", "l_suppkey", 1)
    supplies = brand.select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("B:"), "p_brand").alias("dst"), F.lit("SUPPLIES").alias("rel"), "w")
    buys = buyer.select(F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst"), F.lit("BUYS_FROM").alias("rel"), "w")
    return located.union(within).union(supplies).union(buys)


# The same views for DuckDB: name -> (views it needs, SQL).
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "prices": ((), "SELECT l_suppkey AS ent, CAST(date_trunc('week', l_shipdate) AS DATE) AS dt, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) / sum(l_quantity) AS px, sum(l_quantity) AS vol FROM lineitem GROUP BY 1, 2"),
    "panel": (("prices",), "SELECT ent, dt, max(px) OVER (PARTITION BY ent, grp) AS px, coalesce(vol, 0) AS vol, row_number() OVER (PARTITION BY ent ORDER BY dt) AS bar FROM (SELECT e.ent, w.dt, p.px, p.vol, count(p.px) OVER (PARTITION BY e.ent ORDER BY w.dt) AS grp FROM (SELECT DISTINCT ent FROM prices) e CROSS JOIN (SELECT DISTINCT dt FROM prices) w LEFT JOIN prices p ON p.ent = e.ent AND p.dt = w.dt) WHERE grp > 0"),
    "rets": (("panel",), "SELECT ent, dt, bar, px, vol, ln(px / lag(px) OVER (PARTITION BY ent ORDER BY dt)) AS ret FROM panel"),
    "simple": (("panel",), "SELECT ent, dt, bar, px, vol, px / lag(px) OVER (PARTITION BY ent ORDER BY dt) - 1 AS ret FROM panel"),
    "market": (("rets",), "SELECT dt, avg(ret) AS mret FROM rets GROUP BY dt"),
    "spikes": ((), "SELECT CAST(ent AS VARCHAR) || '-' || strftime(dt, '%Y%m%d') AS event_id, ent, dt FROM (SELECT l_suppkey AS ent, CAST(date_trunc('week', l_shipdate) AS DATE) AS dt, sum(l_quantity) AS qty, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS back FROM lineitem GROUP BY 1, 2) WHERE qty >= 100 AND back > 0.8 * qty"),
    "articles": ((), "SELECT doc_id AS article_id, DATE '1995-01-02' + CAST(doc_id * 37 % 2400 AS INTEGER) AS published_at, 'http://' || source || '.example/' || CAST(doc_id AS VARCHAR) AS url, source AS domain, lang, split_part(text, chr(10), 1) AS title, text FROM documents"),
    "tok": ((), "SELECT doc_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{M}]', ' ', 'g'), ' '), lambda w: w <> '')) AS w FROM documents"),
    "keywords": ((), "SELECT * FROM (VALUES ('worthless', 'abuse', CAST(1.0 AS DECIMAL(9,4))), ('disgusting', 'abuse', CAST(0.8 AS DECIMAL(9,4))), ('pathetic', 'abuse', CAST(0.5 AS DECIMAL(9,4)))) AS k(keyword, category, weight)"),
    "alias": (("tok", "keywords"), "SELECT w AS alias, row_number() OVER (ORDER BY n DESC, w) AS ent FROM (SELECT w, count(DISTINCT doc_id) AS n FROM tok WHERE length(w) >= 9 AND w NOT IN (SELECT keyword FROM keywords) GROUP BY w HAVING count(DISTINCT doc_id) BETWEEN 2 AND 50) QUALIFY row_number() OVER (ORDER BY n DESC, w) <= (SELECT count(*) FROM supplier)"),
    "tagged": (("tok", "alias"), "SELECT doc_id AS article_id, ent, count(*) AS hits FROM tok JOIN alias ON w = alias GROUP BY 1, 2"),
    "scored": (("tok", "keywords"), "SELECT a.article_id, coalesce(s.abuse, 0) AS abuse, coalesce(s.abuse, 0) AS total, coalesce(s.hits, 0) AS hits, a.n_tokens FROM (SELECT d.doc_id AS article_id, count(t.w) AS n_tokens FROM documents d LEFT JOIN tok t ON t.doc_id = d.doc_id GROUP BY 1) a LEFT JOIN (SELECT doc_id, sum(weight) AS abuse, count(*) AS hits FROM tok JOIN keywords ON w = keyword GROUP BY 1) s ON s.doc_id = a.article_id"),
    "universe": ((), "SELECT s_suppkey AS ent, s_name AS name, r_name AS sector, n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "edges0": ((), "SELECT 'S' || s_suppkey AS src, 'N' || s_nationkey AS dst, 'LOCATED_IN' AS rel, CAST(1.0 AS DOUBLE) AS w FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'IN_REGION', 1.0 FROM nation UNION ALL SELECT 'S' || l_suppkey, 'B:' || p_brand, 'SUPPLIES', q / total FROM (SELECT l_suppkey, p_brand, q, sum(q) OVER (PARTITION BY l_suppkey) AS total, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, p_brand) AS r FROM (SELECT l_suppkey, p_brand, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)) WHERE r <= 3 UNION ALL SELECT 'C' || o_custkey, 'S' || l_suppkey, 'BUYS_FROM', q / total FROM (SELECT o_custkey, l_suppkey, q, sum(q) OVER (PARTITION BY o_custkey) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY q DESC, l_suppkey) AS r FROM (SELECT o_custkey, l_suppkey, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)) WHERE r <= 1"),
    "edges": (("edges0",), "SELECT src, dst, rel, max(w) AS w FROM edges0 WHERE src <> dst AND w > 0 GROUP BY 1, 2, 3"),
    "sym": (("edges",), "SELECT src, dst, max(w) AS w FROM (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges) GROUP BY 1, 2"),
    "trans": (("sym",), "SELECT src, dst, w, w / sum(w) OVER (PARTITION BY src) AS p FROM sym"),
    "nodes": (("sym",), "SELECT DISTINCT src AS node FROM sym"),
    "seeds": ((), "SELECT 'N' || n_nationkey AS event_id, 'N' || n_nationkey AS node, CAST(1.0 AS DOUBLE) AS w FROM nation"),
    # event study: estimation and event rows around the spikes
    "aligned": (("spikes", "panel"), "SELECT s.event_id, s.ent, s.dt, min(p.dt) AS bar_dt, min(p.bar) AS bar FROM spikes s JOIN panel p ON p.ent = s.ent AND p.dt >= s.dt AND p.dt <= s.dt + 14 GROUP BY 1, 2, 3"),
    "win": (("aligned", "rets", "market"), "SELECT a.event_id, a.ent, r.bar - a.bar AS tau, r.ret, m.mret FROM aligned a JOIN rets r ON r.ent = a.ent AND r.bar BETWEEN a.bar - 60 AND a.bar + 5 JOIN market m ON m.dt = r.dt WHERE r.ret IS NOT NULL"),
    "fit": (("win",), "SELECT event_id, ent, n, CASE WHEN sxx > 0 THEN sxy / sxx END AS beta, CASE WHEN sxx > 0 THEN my - sxy / sxx * mx END AS alpha, CASE WHEN sxx > 0 THEN (syy - sxy * sxy / sxx) / (n - 2) END AS s2 FROM (SELECT event_id, ent, count(*) AS n, avg(ret) AS my, avg(mret) AS mx, regr_sxx(ret, mret) AS sxx, regr_syy(ret, mret) AS syy, regr_sxy(ret, mret) AS sxy FROM win WHERE tau BETWEEN -60 AND -11 GROUP BY 1, 2) WHERE n >= 50"),
    "ar": (("win", "fit"), "SELECT w.event_id, w.ent, w.tau, w.ret - (f.alpha + f.beta * w.mret) AS ar, f.s2, f.n AS n_est FROM win w JOIN fit f ON f.event_id = w.event_id AND f.ent = w.ent WHERE w.tau BETWEEN -5 AND 5"),
    "car": (("ar",), "SELECT event_id, ent, t1, t2, sum(ar) AS car, CASE WHEN max(s2) >= 1e-12 THEN sum(ar) / (sqrt(max(s2)) * sqrt(count(*))) END AS scar, count(*) AS n, max(n_est) AS n_est FROM ar JOIN (VALUES (-1, 1), (-5, 5), (0, 5)) AS v(t1, t2) ON tau BETWEEN t1 AND t2 GROUP BY 1, 2, 3, 4"),
}


def sql(body: str, *names: str) -> str:
    """A DuckDB query with the named views, and those that they need, before it."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in VIEWS[name][0]:
            need(x)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return ("WITH " + ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in order) + " " if order else "") + body
