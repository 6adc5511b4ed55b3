"""Registered queries: articles, tags, risk, data quality, windows of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplemark.functions.lineage import cut, folder
from ripplemark.functions.numeric import rounded
from ripplemark.operators import ingest
from ripplemark.operators import quality as qc
from ripplemark.plans import fixtures as fx
from ripplemark.plans.fixtures import VIEWS, sql
from ripplemark.sources import readers
from ripplemark.streaming import intake

Q: dict[str, tuple] = {}


def q(x: str) -> str:
    return f"floor(({x}) * 1000000 + 0.5) / 1000000"


def query(name: str, oracle: str | None = None):
    def add(f):
        Q[name] = (f, oracle)
        return f

    return add


def pages_as_articles(s: SparkSession, d: str) -> DataFrame:
    p = fx.table(s, d, "pages")
    return p.select(F.col("page_id").alias("article_id"), F.lit("1995-01-02 10:00:00").cast("timestamp_ntz").alias("published_at"), F.concat(F.lit(" "), "url", F.lit("/")).alias("url"), F.lit(None).cast("string").alias("domain"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.col("html").alias("text"))


@query("ing_normalise_articles", "SELECT page_id AS article_id, CAST('1995-01-02' AS DATE) AS published_at, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) || regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/?#]*', ''), '[?#].*$', ''), '/+$', '') AS url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS domain, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages")
def _(s, d):
    return ingest.normalise_articles(pages_as_articles(s, d)).drop("text")


VIEWS["once"] = (("articles",), "SELECT article_id, published_at, domain FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(trim(lower(text)), '\\s+', ' ', 'g') ORDER BY published_at, article_id) AS r FROM articles) WHERE r = 1")


@query("ing_dedup_articles", sql("SELECT article_id, published_at FROM once", "once"))
def _(s, d):
    return ingest.dedup_articles(fx.articles(s, d)).select("article_id", "published_at")


@query("ing_tag_entities", sql("SELECT article_id, ent, hits FROM tagged", "tagged"))
def _(s, d):
    return ingest.tag_entities(fx.articles(s, d), fx.alias(s, d))


def scored(s: SparkSession, d: str) -> DataFrame:
    return ingest.score_risk(fx.articles(s, d), fx.keywords(s), ["abuse"])


@query("ing_score_risk", sql(f"SELECT article_id, CAST(abuse AS DOUBLE) AS abuse, CAST(total AS DOUBLE) AS total, hits, n_tokens, CASE WHEN n_tokens > 0 THEN {q('hits * 1000.0 / n_tokens')} ELSE 0 END AS per_1000 FROM scored", "scored"))
def _(s, d):
    return rounded(scored(s, d).withColumns({"abuse": F.col("abuse").cast("double"), "total": F.col("total").cast("double")}), "per_1000")


VIEWS["sig"] = (("tagged", "articles", "scored"), "SELECT t.ent, CAST(date_trunc('month', a.published_at) AS DATE) AS dt, count(*) AS n_articles, count(DISTINCT a.domain) AS n_domains, CAST(sum(s.total) AS DOUBLE) AS risk_sum, CAST(max(s.total) AS DOUBLE) AS risk_max FROM tagged t JOIN articles a ON a.article_id = t.article_id JOIN scored s ON s.article_id = t.article_id GROUP BY 1, 2")


def article_signal(s: SparkSession, d: str) -> DataFrame:
    a = fx.articles(s, d)
    out = ingest.article_signal(a, ingest.tag_entities(a, fx.alias(s, d)), scored(s, d), "month")
    return out.withColumns({"risk_sum": F.col("risk_sum").cast("double"), "risk_max": F.col("risk_max").cast("double")})


@query("ing_article_signal", sql("SELECT * FROM sig", "sig"))
def _(s, d):
    return article_signal(s, d)


@query("ing_risk_events", sql(f"SELECT ent, dt, risk_sum, {q('m')} AS mean_before, {q('sd')} AS sd_before FROM (SELECT ent, dt, risk_sum, avg(risk_sum) OVER w AS m, stddev_samp(risk_sum) OVER w AS sd FROM sig WINDOW w AS (PARTITION BY ent ORDER BY dt ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) WHERE sd IS NOT NULL AND risk_sum > m + 1.0 * sd", "sig"))
def _(s, d):
    return rounded(ingest.risk_events(article_signal(s, d)), "mean_before", "sd_before").select("ent", "dt", "risk_sum", "mean_before", "sd_before")


@query("src_conform", "SELECT event_id, TRY_CAST(event_type AS BIGINT) AS kind, event_type IS NOT NULL AND TRY_CAST(event_type AS BIGINT) IS NULL AS kind_failed, FALSE AS event_id_failed, NULL::VARCHAR AS note, FALSE AS note_failed FROM events")
def _(s, d):
    return readers.conform(fx.table(s, d, "events"), {"event_id": "bigint", "kind": "bigint", "note": "string"}, {"kind": "event_type"})


# ---- quality

@query("qc_profile", f"SELECT c AS column_name, n AS rows, nn AS non_null, dn AS distinct, lo AS low, hi AS high, {q('m')} AS mean, {q('sd')} AS sd FROM (SELECT 'event_id' AS c, count(*) AS n, count(event_id) AS nn, count(DISTINCT event_id) AS dn, CAST(min(event_id) AS DOUBLE) AS lo, CAST(max(event_id) AS DOUBLE) AS hi, avg(CAST(event_id AS DOUBLE)) AS m, stddev_samp(CAST(event_id AS DOUBLE)) AS sd FROM events UNION ALL SELECT 'event_type', count(*), count(event_type), count(DISTINCT event_type), NULL, NULL, NULL, NULL FROM events UNION ALL SELECT 'value', count(*), count(value), count(DISTINCT value), min(value), max(value), avg(value), stddev_samp(value) FROM events)")
def _(s, d):
    return rounded(qc.profile(fx.table(s, d, "events").select("event_id", "event_type", "value"), exact=True), "mean", "sd")


@query("qc_completeness", f"SELECT 'text' AS column_name, {q('''avg(CASE WHEN trim(text) <> '' THEN 1.0 ELSE 0.0 END)''')} AS completeness FROM documents UNION ALL SELECT 'source', {q('''avg(CASE WHEN trim(source) <> '' THEN 1.0 ELSE 0.0 END)''')} FROM documents")
def _(s, d):
    return rounded(qc.completeness(fx.table(s, d, "documents"), ["text", "source"]), "completeness")


@query("qc_uniqueness", f"SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS unique_keys, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicated_keys, {q('sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / CAST(sum(n) AS DOUBLE)')} AS uniqueness FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def _(s, d):
    return rounded(qc.uniqueness(fx.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]), "uniqueness")


@query("qc_duplicated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(s, d):
    return qc.duplicated_keys(fx.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("qc_validity", f"SELECT 'discount' AS rule, {q('avg(CASE WHEN l_discount BETWEEN 0 AND 0.05 THEN 1.0 ELSE 0.0 END)')} AS valid FROM lineitem UNION ALL SELECT 'flag', {q('''avg(CASE WHEN l_returnflag IN ('A', 'N') THEN 1.0 ELSE 0.0 END)''')} FROM lineitem UNION ALL SELECT 'quantity', {q('avg(CASE WHEN l_quantity > 10 THEN 1.0 ELSE 0.0 END)')} FROM lineitem")
def _(s, d):
    rules = {"discount": F.col("l_discount").between(0, 0.05), "flag": F.col("l_returnflag").isin("A", "N"), "quantity": F.col("l_quantity") > 10}
    return rounded(qc.validity(fx.table(s, d, "lineitem"), rules), "valid")


@query("qc_conformance", f"SELECT 'event_type' AS column_name, 'present' AS status, {q('avg(CASE WHEN event_type IS NOT NULL AND TRY_CAST(event_type AS BIGINT) IS NULL THEN 1.0 ELSE 0.0 END)')} AS failed FROM events UNION ALL SELECT 'event_id', 'present', {q('avg(CASE WHEN TRY_CAST(event_id AS INTEGER) IS NULL THEN 1.0 ELSE 0.0 END)')} FROM events UNION ALL SELECT 'note', 'missing', NULL UNION ALL SELECT unnest(['props', 'ts', 'user_id', 'value']), 'extra', NULL")
def _(s, d):
    return rounded(qc.conformance(fx.table(s, d, "events"), {"event_id": "int", "event_type": "bigint", "note": "string"}), "failed")


@query("qc_referential", f"SELECT count(*) AS rows, CAST(sum(CASE WHEN o.o_custkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS orphans, {q('avg(CASE WHEN o.o_custkey IS NULL THEN 1.0 ELSE 0.0 END)')} AS orphan_ratio FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON o.o_custkey = c.c_custkey")
def _(s, d):
    return rounded(qc.referential(fx.table(s, d, "customer"), fx.table(s, d, "orders"), "c_custkey", "o_custkey"), "orphan_ratio")


@query("qc_orphans", "SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(s, d):
    return qc.orphans(fx.table(s, d, "customer"), fx.table(s, d, "orders"), "c_custkey", "o_custkey").select("c_custkey", "c_nationkey")


@query("qc_coverage", sql(f"SELECT ent, count(*) AS present, max(i) - min(i) + 1 AS expected, coalesce(max(i - before - 1), 0) AS longest_gap, {q('count(*) / CAST(max(i) - min(i) + 1 AS DOUBLE)')} AS coverage FROM (SELECT p.ent, c.i, lag(c.i) OVER (PARTITION BY p.ent ORDER BY c.i) AS before FROM prices p JOIN (SELECT dt, row_number() OVER (ORDER BY dt) AS i FROM (SELECT DISTINCT dt FROM prices)) c ON c.dt = p.dt) GROUP BY ent", "prices"))
def _(s, d):
    p = fx.prices(s, d)
    return rounded(qc.coverage(p, p.select("dt")), "coverage")


@query("qc_freshness", "SELECT event_type, CAST(min(ts) AS DATE) AS first, CAST(max(ts) AS DATE) AS last, CAST(DATE '2024-02-01' - CAST(max(ts) AS DATE) AS INTEGER) AS lag_days FROM events GROUP BY 1")
def _(s, d):
    return qc.freshness(fx.table(s, d, "events"), "ts", "2024-02-01", ["event_type"])


@query("qc_outliers", sql(f"WITH m AS (SELECT ent, median(px) AS median FROM prices GROUP BY 1), o AS (SELECT p.ent, p.dt, p.px, m.median, abs(p.px - m.median) AS off FROM prices p JOIN m USING (ent)), a AS (SELECT ent, median(off) AS mad FROM o GROUP BY 1) SELECT o.ent, o.dt, {q('o.px')} AS px FROM o JOIN a USING (ent) WHERE a.mad > 0 AND o.off > 3.0 * 1.4826 * a.mad", "prices").replace(") WITH m AS", "), m AS"))
def _(s, d):
    return rounded(qc.outliers(fx.prices(s, d), "px", ["ent"], 3.0), "px").select("ent", "dt", "px")


@query("qc_cardinality", "SELECT 'l_partkey' AS column_name, count(DISTINCT l_partkey) AS exact, TRUE AS close FROM lineitem UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey), TRUE FROM lineitem")
def _(s, d):
    return qc.cardinality(fx.table(s, d, "lineitem"), ["l_partkey", "l_suppkey"]).select("column_name", "exact", (F.col("relative_error") < 0.15).alias("close"))


@query("qc_quantiles", f"SELECT l_returnflag, p AS q, {q('e')} AS exact FROM (SELECT l_returnflag, unnest([0.1, 0.5, 0.9]) AS p, unnest(quantile_cont(l_extendedprice, [0.1, 0.5, 0.9])) AS e FROM lineitem GROUP BY 1)")
def _(s, d):
    return rounded(qc.quantiles(fx.table(s, d, "lineitem"), "l_extendedprice", [0.1, 0.5, 0.9], ["l_returnflag"]).drop("approximate"), "exact")


@query("qc_top_values", f"SELECT l_partkey AS value, count(*) AS n, {q('count(*) / CAST((SELECT count(*) FROM lineitem) AS DOUBLE)')} AS share FROM lineitem GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def _(s, d):
    return rounded(qc.top_values(fx.table(s, d, "lineitem"), "l_partkey", 10), "share")


@query("qc_stale_runs", sql('SELECT ent, min(dt) AS start, max(dt) AS "end", count(*) AS length FROM (SELECT *, sum(n) OVER (PARTITION BY ent ORDER BY dt) AS run FROM (SELECT *, CASE WHEN px = lag(px) OVER (PARTITION BY ent ORDER BY dt) THEN 0 ELSE 1 END AS n FROM panel)) GROUP BY ent, run HAVING count(*) >= 3', "panel"))
def _(s, d):
    return qc.stale_runs(fx.panel(s, d), 3)


def quality_report(s: SparkSession, d: str) -> DataFrame:
    docs, items = fx.table(s, d, "documents"), fx.table(s, d, "lineitem")
    m = qc.completeness(docs, ["text", "source"]).select(F.lit("documents").alias("table_name"), "column_name", F.lit("completeness").alias("metric"), F.col("completeness").alias("value"))
    m = m.unionByName(qc.uniqueness(items, ["l_orderkey", "l_linenumber"]).select(F.lit("lineitem").alias("table_name"), F.lit("l_orderkey").alias("column_name"), F.lit("uniqueness").alias("metric"), F.col("uniqueness").alias("value")))
    t = s.createDataFrame([("completeness", 0.99, 0.9), ("uniqueness", 0.999, 0.9)], "metric string, warn double, fail double")
    return qc.data_quality_report(m, t)


REPORT = f"SELECT *, CASE WHEN value IS NULL OR value < fail THEN 'fail' WHEN value < warn THEN 'warn' ELSE 'pass' END AS verdict FROM (SELECT 'documents' AS table_name, 'text' AS column_name, 'completeness' AS metric, {q('''avg(CASE WHEN trim(text) <> '' THEN 1.0 ELSE 0.0 END)''')} AS value, CAST(0.99 AS DOUBLE) AS warn, CAST(0.9 AS DOUBLE) AS fail FROM documents UNION ALL SELECT 'documents', 'source', 'completeness', {q('''avg(CASE WHEN trim(source) <> '' THEN 1.0 ELSE 0.0 END)''')}, 0.99, 0.9 FROM documents UNION ALL SELECT 'lineitem', 'l_orderkey', 'uniqueness', {q('sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / CAST(sum(n) AS DOUBLE)')}, 0.999, 0.9 FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber))"


@query("qc_report", REPORT)
def _(s, d):
    return rounded(quality_report(s, d), "value")


@query("qc_gate", f"SELECT table_name, CASE max(CASE verdict WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS verdict, count(*) AS checks FROM ({REPORT}) GROUP BY 1")
def _(s, d):
    return qc.quality_gate(quality_report(s, d))


GATE = f"SELECT table_name, max(CASE WHEN verdict = 'fail' THEN 1 ELSE 0 END) AS f FROM ({REPORT}) GROUP BY 1"


@query("qc_route", " UNION ALL ".join(f"SELECT '{t}' AS table_name, CASE WHEN f = 1 THEN 'aside' ELSE 'passed' END AS part, (SELECT count(*) FROM {t}) AS n FROM ({GATE}) WHERE table_name = '{t}'" for t in ("documents", "lineitem")))
def _(s, d):
    gate, out = cut(qc.quality_gate(quality_report(s, d))), None
    for name in ("documents", "lineitem"):
        for part, rows in zip(("passed", "aside"), qc.routed(fx.table(s, d, name), name, gate), strict=True):
            n = rows.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(name).alias("table_name"), F.lit(part).alias("part"), "n")
            out = n if out is None else out.unionByName(n)
    return out


# ---- files: what readers make of files written from the given tables

def written(df: DataFrame, kind: str = "csv", **options) -> str:
    path = folder(df.sparkSession)
    df.write.format(kind).options(**({"header": True, "escape": '"'} if kind == "csv" else {}), **options).save(path)
    return path


@query("src_universe", sql("SELECT CAST(ent AS VARCHAR) AS ent, name, sector, country FROM universe", "universe"))
def _(s, d):
    u = fx.universe(s, d).withColumn("ent", F.col("ent").cast("string"))
    base = folder(s)
    u.filter("ent % 2 = 0").select("country", "name", "ent", "sector").coalesce(1).write.csv(f"{base}/a_combined.csv", header=True, escape='"')
    u.coalesce(1).write.csv(f"{base}/b_combined.csv", header=True, escape='"')
    return readers.read_universe(s, f"{base}/*_combined.csv/*.csv")


@query("src_tickers", "SELECT upper(trim(s_name)) AS ent, s_suppkey FROM supplier WHERE s_suppkey % 3 = 0")
def _(s, d):
    supplier = fx.table(s, d, "supplier")
    path = written(supplier.filter("s_suppkey % 3 = 0").select(F.concat(F.lit("  "), F.lower("s_name"), F.lit(" ")).alias("value")), "text")
    return readers.restrict(supplier.select(F.upper(F.trim("s_name")).alias("ent"), "s_suppkey"), readers.read_tickers(s, path))


@query("src_seed_edges", sql(f"SELECT src, dst, rel, {q('w')} AS w FROM edges0", "edges0"))
def _(s, d):
    return rounded(readers.read_seed_edges(s, written(fx.seed_edges(s, d).select("w", "rel", "dst", "src"))), "w")


@query("src_articles", "SELECT doc_id AS article_id, md5(coalesce(text, '')) AS text_md5, source AS domain FROM documents")
def _(s, d):
    a = fx.articles(s, d).withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))
    good, _ = readers.read_articles(s, written(a.select("text", "article_id", "published_at", "url", "domain", "lang", "title")))
    return good.select("article_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "domain")


@query("src_prices", sql(f"SELECT CAST(ent AS VARCHAR) AS ent, dt, {q('px')} AS px, vol FROM prices", "prices"))
def _(s, d):
    p = fx.prices(s, d).withColumn("ent", F.col("ent").cast("string"))
    return rounded(readers.read_prices(s, written(p, "parquet"), "parquet"), "px")


FILED = "SELECT l_orderkey AS filing_id, CAST(min(l_suppkey) AS VARCHAR) AS ent, min(l_shipdate) AS filed_at, max(l_returnflag) AS form FROM lineitem GROUP BY 1"


@query("src_filings", FILED)
def _(s, d):
    f = fx.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("filing_id")).agg(F.min("l_suppkey").cast("string").alias("ent"), F.min("l_shipdate").alias("filed_at"), F.max("l_returnflag").alias("form"))
    return readers.read_filings(s, written(f.withColumn("text", F.lit("a\nb")), "json")).select("filing_id", "ent", "filed_at", "form")


@query("src_risk_keywords", "SELECT p_name AS keyword, min(p_brand) AS category, CAST(max(p_size) AS DOUBLE) AS weight FROM part GROUP BY 1")
def _(s, d):
    k = fx.table(s, d, "part").groupBy(F.col("p_name").alias("keyword")).agg(F.max("p_size").alias("weight"), F.min("p_brand").alias("category"))
    return readers.read_risk_keywords(s, written(k)).select("keyword", "category", F.col("weight").cast("double").alias("weight"))


@query("snk_processed", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem GROUP BY 1, 2")
def _(s, d):
    path, rows = folder(s), fx.table(s, d, "lineitem").select("l_orderkey", "l_linestatus", "l_returnflag")
    readers.write_processed(rows, path, ["l_returnflag"])
    readers.write_processed(rows.filter("l_returnflag = 'R'"), path, ["l_returnflag"])  # again: replaces its own partition only
    return s.read.parquet(path).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query("snk_report_tables", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    path = folder(s)
    readers.write_report_tables({"by_type": fx.table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))}, path)
    return s.read.schema("event_type string, n bigint").json(f"{path}/by_type")


# ---- windows over the event stream, on the batch side of the same code

@query("x_tumbling_risk", f"SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, {q('sum(value)')} AS total FROM events GROUP BY 1, 2")
def _(s, d):
    return rounded(intake.tumbling(fx.table(s, d, "events")), "total")


@query("x_sliding_risk", "SELECT time_bucket(INTERVAL '1 hour', ts) - k * INTERVAL '1 hour' AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) AS v(k) GROUP BY 1, 2")
def _(s, d):
    return intake.sliding(fx.table(s, d, "events"))


@query("x_session_risk", "SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sess FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '30 minutes' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, sess")
def _(s, d):
    return intake.sessions(fx.table(s, d, "events"))


@query("x_dedup_intake", "SELECT count(*) AS n FROM (SELECT DISTINCT regexp_replace(trim(lower(text)), '\\s+', ' ', 'g') FROM documents)")
def _(s, d):
    return intake.dedup_intake(fx.articles(s, d)).agg(F.count("*").alias("n"))


# ---- the same over streams of files: slices land one after the other, and each run goes on from the checkpoint of the one before

SLICES = 3


def slices(df: DataFrame, at: str) -> list[DataFrame]:
    """df by equal spans of a time column, in order; rows without a time come first."""
    low, high = df.agg(F.min(at), F.max(at)).select(*[F.unix_micros(F.col(c).cast("timestamp")) for c in (f"min({at})", f"max({at})")]).first()
    number = F.coalesce(F.floor((F.unix_micros(F.col(at).cast("timestamp")) - F.lit(low)) * F.lit(SLICES) / F.lit((high or 0) - (low or 0) + 1)), F.lit(0))
    return [df.filter(number == i) for i in range(SLICES)]


def streamed(df: DataFrame, at: str, run) -> str:
    """The folder that run(stream, path, checkpoint) has filled, called once for each slice."""
    s, base = df.sparkSession, folder(df.sparkSession)
    for part in slices(df, at):
        part.write.mode("append").parquet(f"{base}/landed")
        run(intake.read_stream(s, f"{base}/landed", part.schema, 1 << 20), f"{base}/out", f"{base}/checkpoint")
    return f"{base}/out"


@query("x_tumbling_stream", Q["x_tumbling_risk"][1])
def _(s, d):
    events = fx.table(s, d, "events").select("ts", "event_type", "value")
    path = streamed(events, "ts", lambda stream, out, done: intake.upserts(intake.tumbling(stream), out, done))
    return rounded(intake.latest(s, path, ["start", "event_type"]), "total").withColumn("start", F.col("start").cast(events.schema["ts"].dataType))


@query("x_sliding_stream", Q["x_sliding_risk"][1])
def _(s, d):
    events = fx.table(s, d, "events").select("ts", "event_type")
    path = streamed(events, "ts", lambda stream, out, done: intake.upserts(intake.sliding(stream), out, done))
    return intake.latest(s, path, ["start", "event_type"]).withColumn("start", F.col("start").cast(events.schema["ts"].dataType))


@query("x_dedup_stream", sql("SELECT article_id, published_at FROM once", "once"))
def _(s, d):
    articles = fx.articles(s, d).select("article_id", "published_at", "text")
    return s.read.parquet(streamed(articles, "published_at", intake.intake)).select("article_id", "published_at")
