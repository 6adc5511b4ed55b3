"""Groups of documents with alike spot signatures: a join by set length with a pruned Jaccard index.

Sets are partitioned by length: a set is in the band of its own length and in
the next, so that two of a likeness of SHARE or more meet in one.  Of each set,
only the first n - ceil(SHARE * n) + 1 signatures are indexed, in an order that
all sets share; two that are alike enough have one of these in common.  The
order is by how often a signature comes up in one of ORDER texts, then by its
value: common ones come last.  It is a matter of speed alone, as any order
finds the same pairs.

Sets that meet are pruned by their lengths and by their differing bits: of
BITS bits, each tells whether an odd number of a set's signatures fall on it,
so that two sets differ in at least as many signatures as bits.  What is left
is joined by union-find; in each of these wider groups full sets are compared
until every one has met every one that it is not joined with yet.  No pair
leaves its task but for links that span what they join.

A key or group with over BLOCK sets, or over WEIGHT bytes of them, is cut into
blocks, and every pair of blocks is a task of its own.

Defined results: null texts read as empty, and empty texts are one group; equal
texts are in one group; a null doc_id sorts after all others; equal doc_ids are
separate rows; very long texts are taken whole, one at a time; an empty table
gives no rows.  Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as t
from .common import small, staged
from .components import components
from .spotsigs import signatures
from .superminhash import BLOCK, LINKS, WEIGHT, _in_blocks, _near

#: Likeness from which two sets are linked, as a fraction.
SHARE = (80, 100)
BITS, WIDE = 512, 4096  # where sets meet, and where they are compared in full

#: Keys with at most so many sets are compared together, a batch at a time.
FEW = 32

#: The order of signatures: one of so many texts is counted; signatures counted LEAST times or more are known, at most KNOWN of them.
ORDER, LEAST, KNOWN = 16, 4, 200_000


def record(bits: int = BITS) -> np.dtype:
    """Length and bits of a set."""
    return np.dtype([("n", "<i8"), ("bits", "<u8", bits // 64)])


def prefix_length(n: np.ndarray, share: tuple[int, int] = SHARE) -> np.ndarray:
    """How many of n ordered signatures hold one that any set alike enough also has among its first."""
    return n + (-share[0] * n) // share[1] + 1


def records(sets: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """For each set its length and, for each bit, whether an odd number of its signatures fall on it."""
    odd = np.zeros((len(sets), bits), np.uint8)
    for row, own in zip(odd, sets, strict=True):
        row[:] = np.bincount(own % bits, minlength=bits) & 1
    out = np.zeros(len(sets), record(bits))
    out["n"], out["bits"] = [len(own) for own in sets], np.packbits(odd, axis=1).view("<u8")
    return out


def first_signatures(sets: list[np.ndarray], known: np.ndarray, often: np.ndarray) -> list[np.ndarray]:
    """The indexed signatures of each set, the rarest; known are counted signatures in rising order, the others count 0."""
    flat, lens = np.concatenate(sets), np.array([len(s) for s in sets])
    count = np.zeros(len(flat), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        count = np.where(known[at] == flat, often[at], 0)
    flat = flat[np.lexsort((flat, count, np.repeat(np.arange(len(sets)), lens)))]
    start = np.cumsum(lens) - lens
    return [flat[s : s + n] for s, n in zip(start.tolist(), prefix_length(lens).tolist(), strict=True)]


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, buf, offsets in t.chunks(batch.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(signatures(buf, offsets)).astype(np.int64))], names=["sig"])


def common_signatures(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent signatures of one of ORDER texts in rising order, at most KNOWN, and their counts."""
    part = rows.filter(F.pmod(F.xxhash64("text"), F.lit(ORDER)) == 0).select("text").mapInArrow(_occurrences, "sig bigint")
    counts = staged(part.groupBy("sig").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") > total // KNOWN).orderBy("sig").toPandas()  # fewer than KNOWN, as they share the total
    return found["sig"].to_numpy(np.uint32), found["n"].to_numpy(np.int64)


def _name(own: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    d = xxhash.xxh3_128_intdigest(own.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def _signed(order):
    """doc_id, the marks of the text, the set's name, its record, and its indexed signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = order.value
        for batch in batches:
            others = [batch.column(c) for c in ("doc_id", "text_a", "text_b")]
            for low, high, buf, offsets in t.chunks(batch.column("text")):
                sets = signatures(buf, offsets)
                names = [_name(s) for s in sets]
                known_by = records(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(low, high - low) for c in others),
                        pa.array([n[0] for n in names], pa.int64()),
                        pa.array([n[1] for n in names], pa.int64()),
                        pa.array(known_by["n"]),
                        pa.array([r.tobytes() for r in known_by], pa.binary()),
                        pa.array([s.view(np.int32) for s in first_signatures(sets, known, often)], pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "text_a", "text_b", "a", "b", "n", "places", "sigs"],
                )

    return run


def unlike(known: np.ndarray, i, among: np.ndarray, share: tuple[int, int] = SHARE) -> np.ndarray:
    """Which of the sets `among` are, by length or differing bits, less alike than `share` to the i-th, or each to its own one of i."""
    n, m = known["n"][i], known["n"][among]
    apart = np.bitwise_count(known["bits"][among] ^ known["bits"][i]).sum(axis=1, dtype=np.int64)
    short = share[1] * np.minimum(n, m) < share[0] * np.maximum(n, m)
    return short | ((share[0] + share[1]) * apart > (share[1] - share[0]) * (n + m))


def spanning(known: np.ndarray, sets: list[np.ndarray] | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the parts of sets that may be alike, or with full sets, are; with `side`, only pairs of different sides are compared."""
    n = len(known)
    parts, links, places = np.arange(n), [], np.arange(n)
    wide = records(sets, WIDE) if sets is not None else None
    for i in range(n):
        among = places[i + 1 :][parts[i + 1 :] != parts[i]]
        if side is not None:
            among = among[side[among] != side[i]]
        if not len(among):
            continue
        close = among[~unlike(known, i, among)]
        if sets is not None and len(close):
            close = close[~unlike(wide, i, close)]
            close = _near(sets, i, close, SHARE) if len(close) else close
        for j in close.tolist():
            if parts[j] != parts[i]:
                links.append((i, j))
                parts[parts == parts[j]] = parts[i]
    return links


def spanning_few(known: np.ndarray, start: np.ndarray, lens: np.ndarray, side: np.ndarray, crossed: np.ndarray) -> list[tuple[int, int]]:
    """As spanning() without sets, for many short runs of rows; of a crossed run, only pairs of different sides are compared."""
    part: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := part.get(x, x)) != x:
            x = up
        return x

    links = []
    for n in np.unique(lens).tolist():
        i, j = np.triu_indices(n, 1)
        base = start[lens == n]
        i, j = (base[:, None] + i).ravel(), (base[:, None] + j).ravel()
        ok = ~crossed[i] | (side[i] != side[j])
        i, j = i[ok], j[ok]
        near = ~unlike(known, i, j)
        for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True):
            a, b = top(x), top(y)
            if a != b:
                links.append((x, y))
                part[max(a, b)] = min(a, b)
    return links


def _links(with_sets: bool):
    """Links of each run of equal (g, h, low, high) in rows sorted by these."""

    def emit(rows: pa.Table, start: np.ndarray) -> pa.RecordBatch:
        lens = np.diff(np.r_[start, rows.num_rows])
        known = np.frombuffer(b"".join(rows["places"].to_pylist()), record())
        side = rows["side"].to_numpy()
        crossed = rows["low"].to_numpy() != rows["high"].to_numpy()
        few = (lens > 1) & (lens <= FEW) & (not with_sets)
        links = spanning_few(known, start[few], lens[few], side, crossed)
        for low, n in zip(start[(lens > 1) & ~few].tolist(), lens[(lens > 1) & ~few].tolist(), strict=True):
            sets = [np.frombuffer(x, np.uint32) for x in rows["elements"].slice(low, n).to_pylist()] if with_sets else None
            links += [(low + i, low + j) for i, j in spanning(known[low : low + n], sets, side[low : low + n] if crossed[low] else None)]
        one, other = np.array(links, np.int64).reshape(-1, 2).T
        a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (a[one], b[one], a[other], b[other])], names=["a", "b", "c", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = np.stack([rows[c].to_numpy() for c in ("g", "h", "low", "high")])
            start = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1]
            if len(start) > 1:  # the last run may go on in the next batch
                yield emit(rows.slice(0, start[-1]), start[:-1])
            held = rows.slice(start[-1])
        if held is not None and held.num_rows:
            yield emit(held, np.zeros(1, np.int64))

    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        others = [batch.column(c) for c in ("g", "h", "a", "b")]
        for low, high, buf, offsets in t.chunks(batch.column("text")):
            sets = pa.array([s.tobytes() for s in signatures(buf, offsets)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in others), sets], names=["g", "h", "a", "b", "elements"])


def groups(docs: DataFrame, block: int = BLOCK, weight: int = WEIGHT) -> DataFrame:
    """(doc_id, text_a, component_id, component) for every row of docs(doc_id, text).

    text_a is the xxhash64 of the text.  component names a group of rows linked
    by a likeness of SHARE or more and is not null; component_id is its least
    doc_id, null where it has none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marks = (F.xxhash64("text").alias("text_a"), F.xxhash64(F.lit(1), F.col("text")).alias("text_b"))
    order = docs.sparkSession.sparkContext.broadcast(common_signatures(rows))
    signed = staged(rows.select("*", *marks).mapInArrow(_signed(order), "doc_id bigint, text_a bigint, text_b bigint, a bigint, b bigint, n bigint, places binary, sigs array<int>"))
    # a class is known by its set's name; its least doc_id, and one of its texts, stand for it
    classes = staged(signed.groupBy("a", "b").agg(F.min("doc_id").isNull().alias("none"), F.coalesce(F.min("doc_id"), F.lit(0)).alias("least"), F.min(F.struct("text_a", "text_b")).alias("text"), F.min("n").alias("n"), F.min("places").alias("places"), F.min("sigs").alias("sigs")))
    # most indexed signatures are in one set only and meet nothing
    indexed = classes.select(F.explode("sigs").alias("sig"), "a", "b", "n")
    twice = indexed.groupBy("sig").agg(F.count("*").alias("c")).filter("c > 1").select("sig")
    band = F.floor(F.log("n") / F.log(F.lit(SHARE[1] / SHARE[0])) + 1e-9).cast("long")
    keyed = indexed.join(twice, "sig").select(F.col("sig").cast("long").alias("g"), "a", "b", F.explode(F.array(band, band + 1)).alias("h"))
    likely = staged(_in_blocks(keyed, classes, block, weight).mapInArrow(_links(False), LINKS).distinct())
    name = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    wide = components(likely.select(name("a", "b").alias("a"), name("c", "d").alias("b")))
    wide = staged(wide.select(F.col("component.a").alias("g"), F.col("component.b").alias("h"), F.col("node.a").alias("a"), F.col("node.b").alias("b")))
    # full sets of the classes in such a group, from the text that stands for each
    asked = staged(wide.join(classes.select("a", "b", "text"), ["a", "b"]).select("g", "h", "a", "b", F.col("text.text_a").alias("_a"), F.col("text.text_b").alias("_b")))
    same = (F.col("text_a") == F.col("_a")) & (F.col("text_b") == F.col("_b"))
    once = rows.select("text", *marks).join(small(asked.select("_a", "_b")), same, "left_semi").groupBy("text_a", "text_b").agg(F.min("text").alias("text"))
    sets = staged(asked.join(once, same).select("g", "h", "a", "b", "text").mapInArrow(_elements, "g bigint, h bigint, a bigint, b bigint, elements binary"))
    linked = staged(_in_blocks(sets, classes, block, weight, "elements").mapInArrow(_links(True), LINKS))
    least = classes.select("a", "b", F.struct("none", "least", "a", "b").alias("name"))
    ends = linked.join(least.select("a", "b", F.col("name").alias("x")), ["a", "b"]).join(least.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("name").alias("y")), ["c", "d"])
    found = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), F.col("component").alias("found"))
    named = staged(least.join(found, ["a", "b"], "left").select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.coalesce("found", "name").alias("component")))
    out = signed.select("doc_id", "text_a", "a", "b").join(named, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    return out.select("doc_id", "text_a", F.when(~F.col("component.none"), F.col("component.least")).alias("component_id"), F.sha2(F.to_json("component"), 256).alias("component"))
