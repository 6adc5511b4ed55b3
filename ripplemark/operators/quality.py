"""Data-quality checks: each returns a small table of measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.functions.lineage import cut
from ripplemark.functions.quantiles import exact_quantiles
from ripplemark.functions.ranking import few

def profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """Per column rows, non-null, distinct (approximate, or `exact` at the price of a shuffle by values), and for numbers min, max, mean and sd: one pass, then unpivoted."""
    distinct, name = (F.count_distinct, "distinct") if exact else (F.approx_count_distinct, "approx_distinct")
    aggs, cells = [F.count("*").alias("rows")], []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        number = f.dataType.typeName() in ("integer", "long", "double", "float", "decimal", "short")
        aggs += [F.count(c).alias(f"n{i}"), distinct(c).alias(f"d{i}")]
        aggs += [(fn(c.cast("double")) if number else F.lit(None).cast("double")).alias(f"{k}{i}") for k, fn in (("a", F.min), ("b", F.max), ("m", F.avg), ("s", F.stddev_samp))]
        cells.append(F.struct(F.lit(f.name).alias("column_name"), F.col("rows"), F.col(f"n{i}").alias("non_null"), F.col(f"d{i}").alias(name), F.col(f"a{i}").alias("low"), F.col(f"b{i}").alias("high"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("sd")))
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def completeness(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of rows with a value; a blank string counts as null."""
    have = [F.avg(F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", 1.0).otherwise(0.0)).alias(f"c{i}") for i, c in enumerate(cols)]
    return df.agg(*have).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("completeness")) for i, c in enumerate(cols)])).alias("c")).select("c.*")


def duplicated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def uniqueness(df: DataFrame, keys: list[str]) -> DataFrame:
    by = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return by.agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("unique_keys"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("duplicated_keys")).withColumn("uniqueness", F.when(F.col("rows") > 0, F.col("unique_keys") / F.col("rows")))


def validity(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Share of rows that meet each predicate; null counts as not met."""
    names = list(rules)
    row = df.agg(*[F.avg(F.when(rules[n], 1.0).otherwise(0.0)).alias(f"v{i}") for i, n in enumerate(names)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"v{i}").alias("valid")) for i, n in enumerate(names)])).alias("c")).select("c.*")


def conformance(df: DataFrame, contract: dict[str, str]) -> DataFrame:
    """Per column of the contract: present, missing or extra, and the share of values that cannot be cast."""
    have = set(df.columns)
    both = [c for c in contract if c in have]
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit("present").alias("status"), F.col(f"f{i}").alias("failed")) for i, c in enumerate(both)]
    none = F.lit(None).cast("double").alias("failed")
    rows += [F.struct(F.lit(c).alias("column_name"), F.lit(s).alias("status"), none) for s, cs in (("missing", sorted(set(contract) - have)), ("extra", sorted(have - set(contract)))) for c in cs]
    aggs = [F.avg((F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").cast("string").try_cast(contract[c]).isNull()).cast("double")).alias(f"f{i}") for i, c in enumerate(both)]
    return df.agg(F.count("*").alias("rows"), *aggs).select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def referential(child: DataFrame, parent: DataFrame, on: str, parent_on: str) -> DataFrame:
    """Orphans: child rows whose key no parent has."""
    keys = parent.select(F.col(parent_on).alias("_k")).distinct().withColumn("_has", F.lit(True))
    return child.join(keys, child[on] == F.col("_k"), "left").agg(F.count("*").alias("rows"), F.sum(F.when(F.col("_has").isNull(), 1).otherwise(0)).alias("orphans")).withColumn("orphan_ratio", F.when(F.col("rows") > 0, F.col("orphans") / F.col("rows")))


def orphans(child: DataFrame, parent: DataFrame, on: str, parent_on: str) -> DataFrame:
    """The child rows whose key no parent has, a null key among them."""
    return child.join(parent.select(F.col(parent_on).alias("_k")).distinct(), F.col(on) == F.col("_k"), "left_anti")


def coverage(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per entity bars present and expected between its first and last bar, and the longest gap, by calendar numbers."""
    days = calendar.select("dt").distinct().withColumn("i", F.row_number().over(Window.orderBy("dt")))
    rows = prices.select("ent", "dt").distinct().join(F.broadcast(days), "dt")
    gap = F.col("i") - F.lag("i").over(Window.partitionBy("ent").orderBy("i")) - 1
    by = rows.withColumn("gap", gap).groupBy("ent").agg(F.count("*").alias("present"), (F.max("i") - F.min("i") + 1).cast("long").alias("expected"), F.coalesce(F.max("gap"), F.lit(0)).cast("long").alias("longest_gap"))
    return by.withColumn("coverage", F.col("present") / F.col("expected"))


def freshness(df: DataFrame, ts: str, as_of: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.min(F.to_date(ts)).alias("first"), F.max(F.to_date(ts)).alias("last")).withColumn("lag_days", F.datediff(F.lit(as_of).cast("date"), "last"))


def _joined(rows: DataFrame, by: list[str], values: DataFrame, name: str) -> DataFrame:
    """rows with the groups' one value each, null groups among them."""
    names = {b: f"_g{i}" for i, b in enumerate(by)}
    right, on = few(values.select(*[F.col(b).alias(n) for b, n in names.items()], F.col("value").alias(name))), F.lit(True)
    for b, n in names.items():
        on = on & F.col(b).eqNullSafe(F.col(n))
    return rows.join(right, on).drop(*names.values())


def outliers(df: DataFrame, col: str, by: list[str], k: float = 5.0) -> DataFrame:
    """Rows farther than k * 1.4826 * MAD from their group's median; no flag where the MAD is 0."""
    rows = _joined(df, by, cut(exact_quantiles(df, col, [0.5], by)), "median").withColumn("off", F.abs(F.col(col) - F.col("median")))
    return _joined(rows, by, cut(exact_quantiles(rows, "off", [0.5], by)), "mad").filter((F.col("mad") > 0) & (F.col("off") > k * 1.4826 * F.col("mad")))


def cardinality(df: DataFrame, cols: list[str]) -> DataFrame:
    """Exact and approximate numbers of distinct values; each column's values meet by themselves, without the sketches of the others."""
    near = df.agg(*[F.approx_count_distinct(c).alias(f"a{i}") for i, c in enumerate(cols)])
    near = near.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(f"a{i}").alias("approximate")) for i, c in enumerate(cols)])).alias("x")).select("x.*")
    exact = [df.select(F.col(c).alias("v")).distinct().agg(F.count("v").alias("exact")).select(F.lit(c).alias("column_name"), "exact") for c in cols]
    both = reduce(lambda x, y: x.union(y), exact).join(F.broadcast(near), F.col("column_name") == F.col("_c")).drop("_c")
    return both.withColumn("relative_error", F.when(F.col("exact") > 0, F.abs(F.col("approximate") - F.col("exact")) / F.col("exact")))


def quantiles(df: DataFrame, col: str, qs: list[float], by: list[str]) -> DataFrame:
    """Exact interpolated and approximate quantiles per group."""
    near = df.groupBy(*by).agg(F.percentile_approx(col, qs).alias("a")).select(*by, F.posexplode("a").alias("i", "approximate"))
    near = near.select(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)], F.element_at(F.array(*[F.lit(float(q)) for q in qs]), F.col("i") + 1).alias("_q"), "approximate")
    exact, on = exact_quantiles(df, col, qs, by), F.col("q") == F.col("_q")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_g{i}"))
    return exact.join(near, on).select(*by, "q", F.col("value").alias("exact"), "approximate")


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent values with their share of all rows."""
    by = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    return by.orderBy(F.desc("n"), "value").limit(k).crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def stale_runs(prices: DataFrame, k: int = 3) -> DataFrame:
    """Runs of k or more equal consecutive prices."""
    by = Window.partitionBy("ent").orderBy("dt")
    new = F.when(F.col("px") == F.lag("px").over(by), 0).otherwise(1)
    runs = prices.withColumn("_n", new).withColumn("_run", F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("ent", "_run").agg(F.min("dt").alias("start"), F.max("dt").alias("end"), F.count("*").alias("length")).filter(F.col("length") >= k).drop("_run")


def data_quality_report(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """metrics(table_name, column_name, metric, value) against thresholds(metric, warn, fail); a lower value is worse, a missing one fails, and without thresholds it is unchecked."""
    out = metrics.join(F.broadcast(thresholds), "metric", "left")
    return out.withColumn("verdict", F.when(F.col("warn").isNull() & F.col("fail").isNull(), "unchecked").when(F.col("value").isNull() | F.isnan("value") | (F.col("value") < F.col("fail")), "fail").when(F.col("value") < F.col("warn"), "warn").otherwise("pass")).select("table_name", "column_name", "metric", "value", "warn", "fail", "verdict")


def quality_gate(report: DataFrame) -> DataFrame:
    """Per table the worst verdict."""
    levels = F.array(*[F.lit(v) for v in ("pass", "unchecked", "warn", "fail")])
    return report.groupBy("table_name").agg(F.max(F.array_position(levels, F.col("verdict"))).alias("r"), F.count("*").alias("checks")).select("table_name", F.element_at(levels, F.col("r").cast("int")).alias("verdict"), "checks")


def routed(df: DataFrame, name: str, gate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table's rows where the gate lets it pass, and aside where it fails: one of the two is empty. A table that no check names passes."""
    fails = F.broadcast(gate.filter((F.col("table_name") == name) & (F.col("verdict") == "fail")).select(F.lit(True).alias("_fails")).limit(1))
    return df.join(fails, F.lit(True), "left_anti"), df.join(fails, F.lit(True), "left_semi")
