"""Benchmark decontamination by winnowing.

Words are hashed, and of every W consecutive K-gram hashes the least is kept;
with K + W - 1 = WINDOW every shared run of WINDOW words shares a kept hash.
Kept hashes of documents and items meet in a join, and each hit is extended to
the windows around it, which count where their words equal an item's window.
An item of fewer than WINDOW words is one window; it is found by keeping every
gram of its length (winnowing with a window of one).

Documents' hashes that no item has are dropped while the text is read, as long
as the items' hashes number at most FILTER_ROWS; beyond that all kept hashes go
to the join.

Very long texts are whole: each hit is a row, and a task holds ROWS of them.

Defined results: null and empty texts have no words and no hits; a repeated
item_id counts once; a null item_id reads as the empty string; equal doc_ids
are separate rows; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as t
from .common import columns, small, staged, table

WINDOW, K = 10, 5
W = WINDOW - K + 1
FILTER_ROWS = 2_000_000
ROWS = 10_000  # of item windows, or of hits of documents, that a task holds at a time

HIT = pa.struct([("fp", pa.int64()), ("k", pa.int32()), ("at", pa.int32()), ("low", pa.int32()), ("words", pa.list_(pa.string()))])


def _fingerprints(hashes: np.ndarray, first: np.ndarray, short: tuple[int, ...]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(gram length, positions, hashes): winnowed K-grams, and all grams of the short lengths."""
    prefix, out = t.WORDS.prefix(hashes), []
    grams = t.WORDS.grams(prefix, K)
    _, at = t.winnow(grams, t.left_in_document(first, K)[: len(grams)], W)
    at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
    out.append((K, at, grams[at]))
    for k in short:
        grams = t.WORDS.grams(prefix, k)
        at = np.flatnonzero(t.left_in_document(first, k)[: len(grams)] > 0)
        out.append((-k, at, grams[at]))
    return out


def _folded(buf: np.ndarray) -> np.ndarray:
    return t.FOLD[buf]


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, k, fp, window): each window of an item with each fingerprint that may find it; k below 0 marks a short item."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"item_id": pa.array([r[0] for r in rows], pa.string()), "k": pa.array([r[1] for r in rows], pa.int32()), "fp": pa.array([r[2] for r in rows], pa.int64()), "window": pa.array([r[3] for r in rows], pa.string())})

    rows: list[tuple] = []
    for batch in batches:
        ids = batch.column("item_id").to_pylist()
        for i, text in enumerate(batch.column("text").to_pylist()):
            buf = _folded(np.frombuffer((text or "").encode(), np.uint8))
            start, end, first = t.words(buf, np.array([0, len(buf)]), t.ALNUM)
            n = len(start)
            if not n:
                continue
            own = [buf[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)]
            hashes = t.word_hashes(buf, start, end)
            if n < WINDOW:
                rows.append((ids[i], -n, int(t.WORDS.grams(t.WORDS.prefix(hashes), n)[0].astype(np.int64)), " ".join(own)))
                continue
            (_, at, fps), *_ = _fingerprints(hashes, first, ())
            for w in range(n - WINDOW + 1):
                inside = (at >= w) & (at <= w + WINDOW - K)
                rows += [(ids[i], K, int(x), " ".join(own[w : w + WINDOW])) for x in set(fps[inside].astype(np.int64).tolist())]
                if len(rows) >= ROWS:
                    yield made(rows)
                    rows = []
    yield made(rows)


def _document_rows(short: tuple[int, ...], known):
    """A row for each document with its number of words, and one for each of its fingerprints with the words around it, ROWS at a time; a text with very many takes no more memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if known is None else known.value
        for batch in batches:
            rids, ids = batch.column("rid"), batch.column("doc_id")
            for low, high, raw, offsets in t.chunks(batch.column("text")):
                buf = _folded(raw)
                start, end, first = t.words(buf, offsets, t.ALNUM)
                n = high - low
                yield pa.RecordBatch.from_arrays([rids.slice(low, n), ids.slice(low, n), pa.array(np.diff(first), pa.int64()), *(pa.nulls(n, f.type) for f in HIT)], names=["rid", "doc_id", "n_words", *HIT.names])
                hashes, numbers = t.word_hashes(buf, start, end), rids.slice(low, n).to_numpy(zero_copy_only=False)
                for k, at, fps in _fingerprints(hashes, first, short):
                    fps = fps.astype(np.int64)
                    if wanted is not None:
                        found = np.searchsorted(wanted, fps)
                        keep = wanted[np.minimum(found, len(wanted) - 1)] == fps if len(wanted) else np.zeros(len(fps), np.bool_)
                        at, fps = at[keep], fps[keep]
                    doc = np.searchsorted(first, at, "right") - 1
                    begin = first[doc]
                    reach = WINDOW - K if k > 0 else 0
                    a, b = np.maximum(begin, at - reach), np.minimum(first[doc + 1], at + abs(k) + reach)
                    for s in range(0, len(at), ROWS):
                        part = slice(s, s + ROWS)
                        words = [[buf[v:w].tobytes().decode() for v, w in zip(start[y:z].tolist(), end[y:z].tolist(), strict=True)] for y, z in zip(a[part].tolist(), b[part].tolist(), strict=True)]
                        m = len(words)
                        columns = [pa.array(numbers[doc[part]], pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(fps[part]), pa.array(np.full(m, k), pa.int32()), pa.array(at[part] - begin[part], pa.int32()), pa.array(a[part] - begin[part], pa.int32()), pa.array(words, pa.list_(pa.string()))]
                        yield pa.RecordBatch.from_arrays(columns, names=["rid", "doc_id", "n_words", *HIT.names])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, filter_rows: int = FILTER_ROWS, key: str | None = None) -> DataFrame:
    """(rid, doc_id, n_words, n_hit, items, spans) for every row of docs(doc_id, text) against items(item_id, text).

    items: the sorted distinct item_ids with a window in the document; n_hit:
    the words inside any such window.  key: a column with a number for each row,
    which becomes rid; without one, rows are numbered in the written table.
    """
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    index = staged(items.mapInArrow(_item_rows, "item_id string, k int, fp bigint, window string").distinct())
    fps = index.select("fp").distinct()
    known = None
    if fps.limit(filter_rows + 1).count() <= filter_rows:
        known = spark.sparkContext.broadcast(np.sort(fps.toPandas()["fp"].to_numpy()))
    short = tuple(sorted(-r.k for r in index.filter("k < 0").select("k").distinct().collect()))  # of 1 to WINDOW - 1
    rid = F.col(f"`{key}`") if key else F.monotonically_increasing_id()
    read = docs.select(rid.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = staged(read.mapInArrow(_document_rows(short, known), "rid bigint, doc_id bigint, n_words bigint, fp bigint, k int, at int, low int, words array<string>"))
    seen, hits = both.filter("n_words IS NOT NULL"), both.filter("n_words IS NULL")
    hits = hits.join(small(staged(index.select("fp", "k").distinct())), ["fp", "k"], "left_semi")
    # extend: every window of the item's length that holds the gram and lies in the document
    n = F.when(F.col("k") > 0, WINDOW).otherwise(-F.col("k"))
    windows = hits.withColumn("n", n).filter("size(words) >= n").select("rid", "n", "low", "words", F.explode(F.expr("sequence(0, size(words) - n)")).alias("i"))
    windows = windows.select("rid", (F.col("low") + F.col("i")).alias("start"), "n", F.expr("array_join(slice(words, i + 1, n), ' ')").alias("window")).distinct()
    # a window meets the set of its items, not each item; equal sets are one
    sets = staged(index.select("window", "item_id").distinct().groupBy("window").agg(F.sort_array(F.collect_list("item_id")).alias("items")).withColumn("set", F.sha2(F.to_json("items"), 256)))
    spans = staged(windows.join(small(sets.select("window", "set")), "window").select("rid", "start", "n", "set"))
    covered = spans.select("rid", "start", "n").distinct().select("rid", F.explode(F.expr("sequence(start, start + n - 1)")).alias("w")).groupBy("rid").agg(F.countDistinct("w").alias("n_hit"))
    named = small(staged(sets.groupBy("set").agg(F.any_value("items").alias("items"))))
    by_item = spans.select("rid", "set").distinct().join(named, "set").groupBy("rid").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = seen.select("rid", "doc_id", "n_words").join(covered.join(by_item, "rid"), "rid", "left")
    return out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long")).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def op2_winnow_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(columns(table(spark, sf_dir, "documents"), doc_id="long", text="string"), columns(table(spark, sf_dir, "benchmark"), item_id="string", text="string"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
