"""Ingest transforms: articles, tags, risk scores, prices, returns, filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.functions.numeric import tokens


def normalise_articles(df: DataFrame) -> DataFrame:
    """Canonical url (lower-case host, no query, fragment or trailing slash), trimmed title, UTC date."""
    bare = F.regexp_replace(F.regexp_replace(F.trim("url"), r"[?#].*$", ""), r"/+$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1))
    path = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return df.withColumns({"url": F.when(host != "", F.concat(F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit("://"), host, path)).otherwise(bare), "domain": host, "title": F.trim("title"), "published_at": F.to_date("published_at")})


def dedup_articles(df: DataFrame) -> DataFrame:
    """One row for each url, then for each text after lower-casing and collapsing white space: the earliest, then the least id.

    Rows are compared before they are shuffled, so that a text that very many
    articles share is a few rows to its task.
    """
    first = F.struct(F.col("published_at").isNull(), "published_at", F.col("article_id").isNull(), "article_id")
    text = F.sha2(F.regexp_replace(F.trim(F.lower(F.coalesce("text", F.lit("")))), r"\s+", " "), 256)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    by_url = df.groupBy(F.col("url").alias("_k")).agg(F.min_by(row, first).alias("_r")).select("_r.*")
    return by_url.groupBy(text.alias("_k")).agg(F.min_by(row, first).alias("_r")).select("_r.*")


def tag_entities(articles: DataFrame, alias: DataFrame) -> DataFrame:
    """(article_id, ent, hits): aliases that occur as whole words; Spark broadcasts the alias table while it is small."""
    words = articles.select("article_id", F.explode(tokens(F.col("text"))).alias("alias"))
    return words.join(alias, "alias").groupBy("article_id", "ent").agg(F.count("*").alias("hits"))


def score_risk(articles: DataFrame, keywords: DataFrame, categories: list[str]) -> DataFrame:
    """Per article the weight of keyword occurrences by category, their total, and hits per 1000 tokens; sums stay decimal."""
    words = articles.select("article_id", F.explode_outer(tokens(F.col("text"))).alias("keyword")).join(keywords, "keyword", "left")
    sums = [F.sum(F.when(F.col("category") == c, F.col("weight"))).alias(c) for c in categories]
    out = words.groupBy("article_id").agg(F.count("keyword").alias("n_tokens"), *sums, F.sum("weight").alias("total"), F.count("weight").alias("hits"))
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("decimal(19,4)")) for c in [*categories, "total"]}).withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.withColumn("per_1000", F.when(F.col("n_tokens") > 0, F.col("hits") * 1000.0 / F.col("n_tokens")).otherwise(0.0))


def article_signal(articles: DataFrame, tagged: DataFrame, scored: DataFrame, grain: str = "week") -> DataFrame:
    """Per entity and period: articles, distinct domains, sum and maximum of risk."""
    rows = tagged.select("article_id", "ent").join(articles.select("article_id", "published_at", "domain"), "article_id").join(scored.select("article_id", "total"), "article_id")
    return rows.groupBy("ent", F.date_trunc(grain, "published_at").cast("date").alias("dt")).agg(F.count("*").alias("n_articles"), F.countDistinct("domain").alias("n_domains"), F.sum("total").alias("risk_sum"), F.max("total").alias("risk_max"))


def risk_events(signal: DataFrame, z: float = 1.0, lookback: int = 4) -> DataFrame:
    """Rows whose risk exceeds the mean plus z standard deviations of the entity's rows before."""
    before = Window.partitionBy("ent").orderBy("dt").rowsBetween(-lookback, -1)
    risk = F.col("risk_sum").cast("double")
    out = signal.withColumns({"mean_before": F.avg(risk).over(before), "sd_before": F.stddev_samp(risk).over(before)})
    return out.filter((F.col("sd_before").isNotNull()) & (risk > F.col("mean_before") + z * F.col("sd_before")))


def normalise_prices(df: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each (ent, dt), the last by `order` (then by price and volume), with px > 0 and vol >= 0."""
    keys = [F.desc(order)] if order else []
    last = Window.partitionBy("ent", "dt").orderBy(*keys, F.desc("px"), F.desc("vol"))
    return df.filter("px > 0 AND vol >= 0 AND ent IS NOT NULL AND dt IS NOT NULL").withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")


def price_panel(prices: DataFrame, max_fill: int | None = None) -> DataFrame:
    """Every entity on every date from its first bar on; prices are carried at most max_fill bars; bars are numbered.

    A bar stands for the dates up to the entity's next one, by their numbers in the calendar, so that
    bars are shuffled once, by entity, and what follows by entity needs no other shuffle.
    """
    known = prices.filter("ent IS NOT NULL AND dt IS NOT NULL")
    days = known.select("dt").distinct()
    calendar = F.broadcast(days.select("dt", F.row_number().over(Window.orderBy("dt")).alias("_i"), F.count("*").over(Window.partitionBy()).alias("_last")))
    bars = known.join(calendar, "dt").select("ent", "_i", "px", "vol", "_last").withColumn("_next", F.lead("_i").over(Window.partitionBy("ent").orderBy("_i")))
    until = F.greatest(F.col("_i"), F.coalesce(F.col("_next") - 1, F.col("_last")))
    rows = bars.select("ent", F.col("_i").alias("_from"), "px", "vol", F.explode(F.sequence(F.col("_i").cast("long"), until)).alias("_i"))
    seen = F.col("_i") == F.col("_from")
    rows = rows.select("ent", "_i", F.when(seen, F.col("px")).alias("px"), F.when(seen, F.col("vol")).alias("vol")).join(calendar, "_i")
    by = Window.partitionBy("ent").orderBy("dt")
    rows = rows.withColumn("bar", F.row_number().over(by)).withColumn("_at", F.last(F.when(F.col("px").isNotNull(), F.col("bar")), ignorenulls=True).over(by))
    px = F.last("px", ignorenulls=True).over(by)
    if max_fill is not None:
        px = F.when(F.col("bar") - F.col("_at") <= max_fill, px)
    return rows.select("ent", "dt", px.alias("px"), F.coalesce("vol", F.lit(0.0)).alias("vol"), F.col("bar").cast("long").alias("bar"))


def returns(panel: DataFrame, kind: str = "log") -> DataFrame:
    before = F.lag("px").over(Window.partitionBy("ent").orderBy("dt"))
    ratio = F.when((before > 0) & (F.col("px") > 0), F.col("px") / before)
    return panel.withColumn("ret", F.log(ratio) if kind == "log" else ratio - 1)


def market_return(rets: DataFrame, how: str = "equal", benchmark: int | None = None) -> DataFrame:
    """Per date the mean return: of all, weighted by the volume of the bar before, or of one entity."""
    if how == "equal":
        return rets.groupBy("dt").agg(F.avg("ret").alias("mret"))
    if how == "volume":
        w = F.lag("vol").over(Window.partitionBy("ent").orderBy("dt"))
        rows = rets.withColumn("_w", w).filter("ret IS NOT NULL AND _w > 0")
        return rows.groupBy("dt").agg((F.sum(F.col("ret") * F.col("_w")) / F.sum("_w")).alias("mret"))
    return rets.filter(F.col("ent") == benchmark).groupBy("dt").agg(F.max_by("ret", "bar").alias("mret"))


def filing_asof(left: DataFrame, filings: DataFrame) -> DataFrame:
    """For each (ent, dt) the last filing before dt, by a union and a running last value: no range join."""
    mark = filings.select("ent", F.col("filed_at").cast("timestamp_ntz").alias("_t"), F.struct("filing_id", "filed_at").alias("_f"), F.lit(None).cast(left.schema["dt"].dataType).alias("dt"), F.lit(1).alias("_o"))
    ask = left.select("ent", F.col("dt").cast("timestamp_ntz").alias("_t"), F.lit(None).cast(mark.schema["_f"].dataType).alias("_f"), "dt", F.lit(0).alias("_o"))
    by = Window.partitionBy("ent").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = ask.unionByName(mark).withColumn("_l", F.last("_f", ignorenulls=True).over(by))
    return both.filter("_o = 0").select("ent", "dt", F.col("_l.filing_id").alias("filing_id"), F.col("_l.filed_at").alias("filed_at"))
