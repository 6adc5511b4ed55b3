"""SimHash near-duplicates found through pivot distance tables.

Equal fingerprints are one class, so copies are never compared.  Classes are
compared only where some blocks of their bits agree: with the 64 bits in
TOLERANCE + c blocks, two fingerprints at most TOLERANCE bits apart agree in c
blocks whole, and every choice of c blocks is a key.  c grows with the number of
classes, so that unrelated fingerprints seldom share a key.  Inside the rows of
a key, Hamming distances to several reference fingerprints are tabulated; a pair
is dropped where any coordinate differs by more than TOLERANCE, as the triangle
inequality allows, and the survivors are verified.  Only links that join two
parts not linked yet are emitted, at most one less than the rows of the key.

A key with more than BUCKET classes is cut into blocks, and every pair of blocks
is a task of its own; no task grows with a group of copies.

Defined results: null and empty texts have fingerprint zero and link like any
other; a null doc_id sorts after all others and gets the least doc_id of its
component; equal doc_ids are separate rows; very long texts are hashed whole, one
at a time in a task; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, staged, table
from .components import components

SHINGLE, SEED, TOLERANCE = 4, 42, 4
PIVOTS = 8
BUCKET = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64 hashes; 0 without words."""
    words = (text or "").encode().lower().split()  # of bytes: folds A-Z, splits at ASCII white space
    n = max(1, len(words) - shingle + 1) if words else 0
    if not n:
        return 0
    votes = np.zeros(64, np.int64)
    for low in range(0, n, 1 << 16):
        part = range(low, min(n, low + (1 << 16)))
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in part), np.uint64, len(part))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(v.as_py()) for v in batch.column("text")], np.uint64).view(np.int64)
        others = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(fps)], names=[*others, "fp"])


def _widths(n: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, width) of each of `parts` blocks of n bits."""
    cut = [n * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def key_masks(classes: int, tolerance: int = TOLERANCE) -> list[int]:
    """The bit masks of the keys: as many agreeing blocks as give about a key's worth of values for every class."""
    for agree in range(1, 5):
        blocks = _widths(64, tolerance + agree)
        masks = [sum(((1 << w) - 1) << a for a, w in chosen) for chosen in combinations(blocks, agree)]
        if min(m.bit_count() for m in masks) >= np.log2(max(2, classes)) - 1:
            break
    return masks


def bucket_links(fps: np.ndarray, left: int | None = None, tolerance: int = TOLERANCE) -> list[tuple[int, int]]:
    """Links (indexes) that span the parts of a bucket's fingerprints at most `tolerance` apart.

    With `left`, only pairs of one of the first `left` and one of the others are looked at.
    """
    n = len(fps)
    pivots = fps[np.linspace(0, n - 1, min(PIVOTS, n)).astype(int)]
    near = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int16)
    order = np.argsort(near[:, 0], kind="stable")
    fps_o, near_o = fps[order], near[order]
    side = order < left if left is not None else None
    links, parts, label = [], n, np.arange(n)
    for i in range(n - 1):
        if parts == 1:
            break
        stop = np.searchsorted(near_o[:, 0], near_o[i, 0] + tolerance, "right")
        if stop <= i + 1:
            continue
        close = np.abs(near_o[i + 1 : stop, 1:] - near_o[i, 1:]).max(axis=1, initial=0) <= tolerance
        j = np.flatnonzero(close) + i + 1
        j = j[np.bitwise_count(fps_o[j] ^ fps_o[i]) <= tolerance]
        if side is not None:
            j = j[side[j] != side[i]]
        j = j[label[j] != label[i]]
        while len(j):
            links.append((int(order[i]), int(order[j[0]])))
            label[label == label[j[0]]] = label[i]
            parts -= 1
            j = j[label[j] != label[i]]
    return links


def _link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, key, low, high, side, fp) sorted by the first four: the links of each run of equal ones."""
    held: list[pa.RecordBatch] = []

    def links(table: pa.Table) -> pa.RecordBatch:
        cols = [table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("mask", "key", "low", "high")]
        fps, side = table.column("fp").combine_chunks().to_numpy().view(np.uint64), table.column("side").combine_chunks().to_numpy()
        new = np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)] if len(fps) else np.zeros(0, bool)
        at = np.r_[np.flatnonzero(new), len(fps)]
        a, b = [], []
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if e - s < 2:
                continue
            own, two = fps[s:e], cols[2][s] != cols[3][s]
            if two:
                order = np.argsort(side[s:e], kind="stable")
                own, left = own[order], int((side[s:e] == 0).sum())
            for i, j in bucket_links(own, left if two else None):
                a.append(own[i])
                b.append(own[j])
        return pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64))], names=["a", "b"])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "key", "low", "high")]
        tail = np.all([c == c[-1] for c in keys], axis=0)
        start = batch.num_rows - int(np.argmin(tail[::-1])) if not tail.all() else 0
        now = tuple(int(c[-1]) for c in keys)
        if start or (last is not None and last != tuple(int(c[0]) for c in keys)):
            yield links(pa.Table.from_batches([*held, batch.slice(0, start)]))
            held = []
        held.append(batch.slice(start))
        last = now
    if held:
        yield links(pa.Table.from_batches(held))


def near_links(classes: DataFrame, n: int, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints classes(fp), n of them."""
    spark = classes.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    masks = key_masks(n)
    keyed = classes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >= 1 << 63 else m)).alias("key")) for i, m in enumerate(masks)])).alias("k")).select("k.mask", "k.key", "fp")
    large = keyed.groupBy("mask", "key").agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)
    keyed = keyed.join(large, ["mask", "key"])
    # a large bucket is cut into blocks, and each block goes to all pairs of blocks that it is in
    keyed = keyed.withColumn("blocks", F.ceil(F.col("rows") / bucket).cast("int")).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = keyed.select("mask", "key", "fp", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    pairs = pairs.select("mask", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "fp")
    spread = pairs.repartition(parts, "mask", "key", "low", "high").sortWithinPartitions("mask", "key", "low", "high", "fp")
    return spread.mapInArrow(_link_rows, "a bigint, b bigint")


def cluster(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(rid, doc_id, fp, component_id, component) for every row of docs(doc_id, text); component_id can be null or that of several components, component is not.

    key: a column with a number for each row, which becomes rid; without one, rows are numbered in the written table.
    """
    ids = [F.col(f"`{key}`").alias("rid")] if key else []
    rows = docs.select(*ids, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(_fingerprint_rows, f"{'rid bigint, ' if key else ''}doc_id bigint, fp bigint")
    rows = staged(rows if key else rows.withColumn("rid", F.monotonically_increasing_id()))
    # a class is named by its least doc_id, a null one last, then its fingerprint, so that the least name of a component holds the answer and no component is gathered
    least = F.min("doc_id")
    classes = staged(rows.groupBy("fp").agg(least.isNull().alias("none"), F.coalesce(least, F.lit(0)).alias("least")))
    name = classes.select("fp", F.struct("none", "least", "fp").alias("name"))
    links = staged(near_links(classes.select("fp"), classes.count()))
    named = links.join(name.withColumnsRenamed({"fp": "a", "name": "x"}), "a").join(name.withColumnsRenamed({"fp": "b", "name": "y"}), "b")
    found = components(named.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node.fp").alias("fp"), F.col("component").alias("found"))
    groups = name.join(found, "fp", "left").select("fp", F.coalesce("found", "name").alias("component"))
    groups = staged(groups.withColumn("component_id", F.when(~F.col("component.none"), F.col("component.least"))))
    return rows.join(groups, "fp").select("rid", "doc_id", "fp", "component_id", "component")


def op7_pivot_simhash(spark, sf_dir: str) -> DataFrame:
    out = cluster(columns(table(spark, sf_dir, "documents"), doc_id="long", text="string"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
