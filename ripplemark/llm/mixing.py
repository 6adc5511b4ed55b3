"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target in words.  All documents of a source get the same
number of copies, target / source size, whose whole part is taken outright.
The fractional part is a probability that pivotal sampling rounds: two units
meet, mass moves at random from one to the other until one of them is 0 or 1,
and the other goes on with what is left.  Units meet from the largest down, so
that like sizes make up for each other and the words taken stay near the target.  A source
is dealt into blocks of bounded size; each leaves one residual unit at most,
and the residuals meet in a tree of further blocks until one is left.

Defined results: a null or empty text has size 0 (it is rounded like any other
and takes 0 words); a null source is a source of its own, last in order; equal
doc_ids are separate rows, equal rows are numbered among themselves, so that
another reading or splitting of the table gives the same rows; very long texts
are counted whole; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.functions.ranking import positions

from .common import columns, small, staged

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 4096
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) from rows (source, size).

    Filling up: with caps most * size, the targets are min(cap, level * weight)
    for the level at which they sum to share * all sizes.  Sorted by cap /
    weight, the sources before the level are at their caps.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest, every = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    by = by.withColumn("level", level).withColumn("ok", F.col("level") * F.col("weight") <= F.col("cap"))
    by = by.withColumn("fill", F.first(F.when(F.col("ok"), F.col("level")), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap"), F.coalesce(F.col("fill") * F.col("weight"), F.col("cap")))
    return by.select("source", "source_size", "n_docs", target.alias("target"))


def _meet(a: tuple, b: tuple) -> tuple[list[tuple], tuple | None]:
    """Two units (key, probability, random number): which are settled as (key, 0 or 1), and who goes on."""
    (ka, pa, ua), (kb, pb, ub) = a, b
    q, u = pa + pb, (ua + ub) % 1.0
    if q < 1:
        win, lose = (a, b) if u * q < pa else (b, a)
        return [(lose[0], 0)], (win[0], q, win[2])
    win, lose = (a, b) if u * (2 - q) < 1 - pb else (b, a)
    left = q - 1
    settled = [(win[0], 1)]
    if left <= 1e-12:
        return [*settled, (lose[0], 0)], None
    return settled, (lose[0], left, lose[2])


def _round_block(units: pa.Table) -> pa.Table:
    """A block's rows with copy: 0 or 1, or -1 for the residual, whose p is then the probability left."""
    size, p, u, mixed = (units.column(c).to_numpy() for c in ("size", "p", "u", "mixed"))
    order = np.lexsort((mixed, u, -size)).tolist()
    copies, left, goes = [0] * len(p), p.tolist(), None
    for unit in ((i, left[i], float(u[i])) for i in order):
        if unit[1] <= 1e-12:
            continue
        if goes is None:
            goes = unit
            continue
        settled, goes = _meet(goes, unit)
        for k, c in settled:
            copies[k] = c
    if goes is not None:
        copies[goes[0]], left[goes[0]] = -1, goes[1]
    at = units.schema.get_field_index("p")
    return units.set_column(at, "p", pa.array(left, pa.float64())).append_column("copy", pa.array(copies, pa.int32()))


def _rounded(units: DataFrame) -> DataFrame:
    """One level of the tree: a task rounds a block of (source_no, block) at a time; blocks are bounded, so no task grows with a source."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in units.schema.fields)}, copy int"
    return units.groupBy("source_no", "block").applyInArrow(_round_block, schema)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = 11, key: str | None = None) -> DataFrame:
    """(rid, doc_id, size, source_size, target, copies, taken) for every row of docs(doc_id, text, source).

    key: a column with a number for each row, which becomes rid; without one,
    rows are numbered in the written table.
    """
    rid = F.col(f"`{key}`") if key else F.monotonically_increasing_id()
    content = F.xxhash64("doc_id", "source", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(seed))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), content.alias("mixed"), rid.alias("rid"))
    sizes = staged(sizes)
    by = staged(targets(sizes, weights, share, most).withColumn("source_no", F.coalesce(F.xxhash64("source"), F.lit(-1)) + F.when(F.col("source").isNull(), 1).otherwise(0)))
    known = sizes.alias("d").join(small(by).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.rid", "d.doc_id", "d.size", "d.mixed", "s.source_no", "s.source_size", "s.target", "s.n_docs")
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    known = known.withColumn("whole", F.floor(copies + 1e-12).cast("int")).withColumn("p", F.greatest(F.lit(0.0), copies - F.col("whole")))
    # which block a row is in, and its random number, depend on its contents, and where rows are equal on a number among them; which of these gets which doesn't matter
    again = small(staged(sizes.groupBy("mixed").agg(F.count("*").alias("n")).filter("n > 1").select("mixed")))
    equal = positions(staged(sizes.select("mixed", "rid").join(again, "mixed", "left_semi")), ["mixed"], [], "no")
    known = known.join(small(staged(equal.select("rid", "no"))), "rid", "left").withColumn("mixed", F.xxhash64("mixed", F.coalesce("no", F.lit(0)))).drop("no")
    known = known.withColumn("block", F.pmod("mixed", F.ceil(F.col("n_docs") / block)).cast("long")).withColumn("u", F.pmod(F.xxhash64("mixed", F.lit("u")), F.lit(1 << 30)) / float(1 << 30))
    level = staged(_rounded(known.drop("n_docs")))
    done, parts = [level.filter("copy >= 0")], [level.filter("copy < 0")]
    blocks = -(-(by.agg(F.max("n_docs")).first()[0] or 0) // block)
    while blocks > 1:  # each turn divides the residuals by the size of a block
        level = staged(_rounded(parts[-1].drop("copy").withColumn("block", F.floor(F.col("block") / block).cast("long"))))
        done.append(level.filter("copy >= 0"))
        parts.append(level.filter("copy < 0"))
        blocks = -(-blocks // block)
    last = parts[-1].withColumn("copy", (F.col("u") < F.col("p")).cast("int"))
    out = last
    for d in done:
        out = out.unionByName(d)
    copies = (F.col("whole") + F.col("copy")).cast("int")
    res = out.select("rid", "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
    return res


def op8_pivotal_mix(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = columns(table(spark, sf_dir, "documents"), doc_id="long", text="string", source="string")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
