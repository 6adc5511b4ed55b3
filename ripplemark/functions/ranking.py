"""Positions, ntiles and ranks over groups of any size: no task sorts a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.functions.lineage import cut

#: A table of per-partition offsets with at most so many rows is broadcast; a longer one is joined by a shuffle.
OFFSETS = 100_000

#: A group of more rows is cut into parts by mid_ranks(), into PARTS of them at most.
CHUNK, PARTS = 200_000, 256

#: monotonically_increasing_id() holds the partition's number above so many bits.
WITHIN = 33


def few(df: DataFrame, rows: int = OFFSETS) -> DataFrame:
    """Hint a broadcast of a (written) side only where it has few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _same(left: DataFrame, right: DataFrame, keys: list[str], names: list[str]) -> Column:
    on = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        on = on & left[k].eqNullSafe(right[n])
    return on


def positions(df: DataFrame, by: list[str], order: list[str | Column], pos: str = "pos", size: str | None = None) -> DataFrame:
    """Adds each row's number from 0 on within its group, as row_number() - 1 does, and if named the group's size.

    Rows are dealt by ranges of (by, order) and sorted inside these; a range's
    rows of a group are counted, and what the ranges before it hold is added.
    A group of any size thus spreads over all ranges.  Rows that are equal in
    `by` and `order` come in any order, so `order` should name them apart; a
    random last key deals repeated ones to several ranges.  df is read twice
    (ranges are sampled first): give a written table.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [*(F.col(b).asc() for b in by), *(F.col(o).asc() if isinstance(o, str) else o for o in order), F.rand(7)]
    dealt = df.withColumn("_salt", keys.pop()).repartitionByRange(parts, *keys, "_salt").sortWithinPartitions(*keys, "_salt").drop("_salt")
    dealt = cut(dealt.withColumn("_id", F.monotonically_increasing_id()))
    names = [f"_by{i}" for i in range(len(by))]
    part = F.shiftright("_id", WITHIN)
    counts = dealt.groupBy(part.alias("_part"), *[F.col(b).alias(n) for b, n in zip(by, names, strict=True)]).agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    own = Window.partitionBy(*names)  # a row for each range that the group is in
    before = F.coalesce(F.sum("_rows").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(counts.select("_part", *names, "_first", before.alias("_before"), F.sum("_rows").over(own).alias("_size")))
    rows = dealt.withColumn("_part", part).withColumnRenamed("_part", "_in")
    both = rows.join(few(offsets), (F.col("_in") == F.col("_part")) & _same(rows, offsets, by, names))
    out = [*df.columns, (F.col("_before") + F.col("_id") - F.col("_first")).alias(pos)]
    return both.select(*out, *([F.col("_size").alias(size)] if size else []))


def ntiles(df: DataFrame, by: list[str], order: list[str | Column], q: int, name: str = "bucket") -> DataFrame:
    """Adds what ntile(q) gives: q buckets whose sizes differ by at most one, the larger ones first."""
    rows = positions(df, by, order, "_pos", "_n")
    base, more = F.floor(F.col("_n") / q), F.col("_n") % q
    wide = more * (base + 1)  # rows in the larger buckets
    number = F.when(F.col("_pos") < wide, F.floor(F.col("_pos") / (base + 1))).otherwise(more + F.floor((F.col("_pos") - wide) / F.greatest(base, F.lit(1))))
    return rows.withColumn(name, (number + 1).cast("int")).drop("_pos", "_n")


def ranked_values(df: DataFrame, by: list[str], value: str, descending: bool = False, rows: str | None = None) -> DataFrame:
    """(by..., value, n, rnk, dense, total): for each distinct value of a group its rows, rank() and dense_rank(), and the group's rows.

    Equal values are counted before anything is sorted, so ties of any number cost one row.
    If named, the column `rows` says how many rows one of df stands for.
    """
    distinct = cut(df.groupBy(*by, value).agg((F.sum(rows) if rows else F.count("*")).alias("n")))
    placed = positions(distinct, by, [F.col(value).desc() if descending else F.col(value).asc()], "_pos")
    return running(placed, by, "_pos", "n", "rnk", "total").select(*by, value, "n", (F.col("rnk") + 1).cast("int").alias("rnk"), (F.col("_pos") + 1).cast("int").alias("dense"), "total")


def running(df: DataFrame, by: list[str], pos: str, value: str, before: str, total: str, block: int = 4096) -> DataFrame:
    """Adds the sum of `value` over a group's rows at smaller positions, and over all, from blocks of consecutive positions; sums of blocks are summed likewise until a group has one."""
    cols = df.columns
    df = cut(df.withColumn("_block", F.floor(F.col(pos) / block)))
    inner = Window.partitionBy(*by, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(df.groupBy(*by, "_block").agg(F.sum(value).alias("_sum")))
    if (sums.agg(F.max("_block")).first()[0] or 0) == 0:
        upper = sums.select(*by, "_block", F.lit(0).alias("_lower"), F.col("_sum").alias("_total"))
    else:
        upper = running(sums.withColumnRenamed("_block", "_place"), by, "_place", "_sum", "_lower", "_total", block).select(*by, F.col("_place").alias("_block"), "_lower", "_total")
    upper = cut(upper)
    names = {c: f"_u{i}" for i, c in enumerate([*by, "_block"])}
    right = few(upper.withColumnsRenamed(names))
    rows = df.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    both = rows.join(right, _same(rows, right, list(names), list(names.values())))
    return both.select(*cols, (F.col("_lower") + F.col("_inner")).alias(before), F.col("_total").alias(total))


def mid_ranks(df: DataFrame, by: list[str], values: dict[str, str], rows: str, total: str, chunk: int = CHUNK) -> DataFrame:
    """Adds the mid-rank of several values (value -> its rank's name) within their group, and the group's rows.

    `rows` says how many rows one of df stands for.  Where a group has over
    `chunk` rows, groups are cut at rough quantiles of a value, a task sorts
    one part, and the rows of the parts before it are added.  Equal values are
    in one part, so ranks are exact wherever the cuts are.  Only df's rows are
    shuffled, once for each value; df is read several times: give a written table.
    """
    names = [f"_by{i}" for i in range(len(by))]
    keys = [F.col(b).alias(n) for b, n in zip(by, names, strict=True)]
    most = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    parts = min(PARTS, -(-most // chunk))
    place = {v: f"_part{i}" for i, v in enumerate(values)}
    if parts > 1:
        at = [i / parts for i in range(1, parts)]
        cuts = cut(df.groupBy(*keys).agg(*[F.percentile_approx(v, at, 20 * parts).alias(f"_cuts{i}") for i, v in enumerate(values)]))
        number = lambda i, v: F.size(F.filter(f"_cuts{i}", lambda c: c < F.col(v)))
        out = df.join(few(cuts), _same(df, cuts, by, names)).select(*df.columns, *[number(i, v).alias(place[v]) for i, v in enumerate(values)])
    else:
        out = df.select("*", *[F.lit(0).alias(n) for n in place.values()])
    own = Window.partitionBy(*names)  # a row for each part
    before = F.coalesce(F.sum("_rows").over(own.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = {v: cut(out.groupBy(*keys, F.col(p).alias("_at")).agg(F.sum(rows).alias("_rows")).select(*names, "_at", before.alias("_before"), F.sum("_rows").over(own).alias("_sum"))) for v, p in place.items()}
    for v, name in values.items():
        upto = F.sum(rows).over(Window.partitionBy(*by, place[v]).orderBy(v).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        ties = F.sum(rows).over(Window.partitionBy(*by, place[v], v))
        out = out.withColumn("_mid", upto - (ties - 1) / 2)
        both = out.join(few(offsets[v]), _same(out, offsets[v], by, names) & (F.col(place[v]) == F.col("_at")))
        kept = [c for c in out.columns if c not in (place[v], "_mid")]
        out = both.select(*kept, (F.col("_mid") + F.col("_before")).alias(name), *([] if total in kept else [F.col("_sum").alias(total)]))
    return out
