"""Suffix-array dedup of repeated byte strings.

Only passages that occur with different surroundings reach a shard (see
repeats.py).  A shard's passages are put in one sequence of words, its suffix
array is built by linear grouping (see suffix_array.py), and runs of suffixes
that share enough bytes give the windows of LENGTH bytes that repeat; those that
a smaller doc_id has, or the same row further ahead, are removed.

Defined results: null texts read as empty; a null doc_id counts as larger than
all others; rows with equal doc_ids do not remove each other's bytes; very long
texts are read whole, one at a time in a task; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as t
from .common import columns, staged, table
from .repeats import Span, Unit, anchors, cut, recurring, removal, repeats
from .suffix_array import common, suffix_array

LENGTH, K = 100, 40
UNIT = Unit(words=False, length=LENGTH, k=K, within=True)


#: Bytes that end a symbol; where symbols get longer than LONGEST, further bytes become such ends.
ENDS = np.array([not (chr(b).isascii() and chr(b).isalnum()) and not 0x80 <= b < 0xE0 for b in range(256)])
LONGEST = 48


def _symbols(data: np.ndarray) -> np.ndarray:
    """Past the last byte of each symbol; a symbol has one end byte, its last, so that no symbol is the beginning of another."""
    ends = ENDS.copy()
    while True:
        stop = np.flatnonzero(ends[data]) + 1
        size = np.diff(np.r_[0, stop])
        if not len(size) or size.max() <= LONGEST:
            return stop
        long = np.flatnonzero(size > LONGEST)
        inside = np.concatenate([data[stop[i] - size[i] : stop[i] - 1] for i in long.tolist()])
        ends[np.bincount(inside, minlength=256).argmax()] = True


def match(spans: list[Span], length: int = LENGTH, rows: list[int] | None = None) -> list[tuple[int, int, int]]:
    """Spans of bytes whose windows start earlier: in a smaller document, or before in the same row; they are named by their rows, or without these by doc_id.

    The suffix array is that of symbols, the words with the byte behind them,
    numbered in byte order.  A window that starts s bytes before a symbol
    repeats another one if these s bytes are equal and the suffixes from the
    symbol on share length - s bytes, which makes them neighbours in order.
    """
    sizes = np.array([len(s[2]) for s in spans])
    gap = np.r_[0, np.cumsum(sizes + 1)]
    data = np.zeros(int(gap[-1]), np.uint8)
    left, doc, row, place = (np.zeros(len(data) + 1, np.int64) for _ in range(4))
    for (d, at, content), r, s, n in zip(spans, rows or [s[0] for s in spans], gap[:-1].tolist(), sizes.tolist(), strict=True):
        data[s : s + n] = np.frombuffer(content, np.uint8)
        left[s : s + n], doc[s : s + n], row[s : s + n], place[s : s + n] = np.arange(n, 0, -1), d, r, at + np.arange(n)
    stop = _symbols(data)
    start = np.r_[0, stop[:-1]]
    raw = data.tobytes()
    bare = stop - np.isin(stop, gap[1:])  # the byte between passages is no part of a name, and so differs from a zero byte in a text
    names = [raw[a:b] for a, b in zip(start.tolist(), bare.tolist(), strict=True)]
    number = {x: i for i, x in enumerate(sorted(set(names)))}
    order = suffix_array(np.fromiter((number[x] for x in names), np.int64, len(names)))
    shared = common(data, left, start[order], length)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    prefix, mine = t.BYTES.prefix(data), left[start]
    first = np.lexsort((place[start], row[start], doc[start]))  # symbols by the place of their text
    first = first[(first > 0) & (left[start[first] - 1] == mine[first] + 1)]  # those with a symbol before them in their passage
    before, room = stop[first - 1] - start[first - 1], mine[first]
    found = []
    for s in range(1, int(before.max(initial=0)) + 1):
        # windows that start s bytes before a symbol, in the one before it or where that begins
        keep = before >= s
        if not keep.all():
            first, before, room = first[keep], before[keep], room[keep]
        at = first[room >= length - s]
        if len(at) < 2:
            continue
        run = np.r_[0, np.cumsum(shared < length - s)][rank[at]].astype(np.uint64)
        p = start[at]
        key = t.mix(t.BYTES.spans(prefix, p - s, p) + run * t.U(0x9E3779B97F4A7C15))
        by = np.argsort(key, kind="stable")
        key, p = key[by], p[by] - s
        new = np.r_[True, key[1:] != key[:-1]]
        head, mine_first = (np.maximum.accumulate(np.where(x, np.arange(len(p)), 0)) for x in (new, new | np.r_[True, row[p[1:]] != row[p[:-1]]]))
        found.append(p[(doc[p] != doc[p[head]]) | (place[p] != place[p[mine_first]])])
    late = np.concatenate(found) if found else np.zeros(0, np.int64)
    if not len(late):
        return []
    late = late[np.lexsort((place[late], row[late]))]
    out = []
    own, first = np.unique(row[late], return_index=True)
    for d, a, b in zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(late)], strict=True):
        at = place[late[a:b]]
        out += [(d, x, y) for x, y in zip(*(v.tolist() for v in t.merge_spans(at, at + length)), strict=True)]
    return out


def _kept_rows(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, pieces, kept, rest = [], [], [], [], []
            known, spans = batch.column("known"), batch.column("spans")
            for low, high, buf, offsets in t.chunks(batch.column("text")):
                c = cut(unit, buf, offsets)
                a = anchors(unit, c)
                by, twice = np.searchsorted(a.doc, np.arange(high - low + 1)), recurring(unit, a, high - low).tolist()
                for i in range(high - low):
                    k, s = known[low + i].values, spans[low + i].values
                    s = np.column_stack([s.field(0).to_numpy(), s.field(1).to_numpy()]) if s is not None else None
                    start, end = removal(unit, c, a, i, slice(by[i], by[i + 1]), k.to_numpy() if k is not None else None, s, twice[i])
                    own = buf[offsets[i] : offsets[i + 1]]
                    keep = b"".join(own[x:y].tobytes() for x, y in zip([0, *end.tolist()], [*start.tolist(), len(own)], strict=True))
                    sizes.append(len(own))
                    gone.append(int((end - start).sum()))
                    pieces.append(len(start))
                    kept.append(hashlib.sha256(keep).hexdigest())
                    rest.append(keep if gone[-1] else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(pieces, pa.int64()), pa.array(kept, pa.string()), pa.array(rest, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "rest"])

    return run


def dedup(docs: DataFrame, unit: Unit = UNIT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, rest) for every row of docs(doc_id, text); rest: the kept bytes, null where none went."""
    numbered = staged(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    found = repeats(numbered, unit, match)
    return numbered.join(found, "rid", "left").drop("rid").mapInArrow(_kept_rows(unit), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, rest binary")


def op9_suffix_array_bytes(spark, sf_dir: str) -> DataFrame:
    return dedup(columns(table(spark, sf_dir, "documents"), doc_id="long", text="string")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
