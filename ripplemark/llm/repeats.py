"""Where texts repeat: the part that exact substring operators share.

A text is a row of symbols (bytes or words).  Every window of `length` symbols
chooses an anchor, the least of its k-grams (winnowing), so that equal windows
choose equal anchors.  An anchor with all windows that hold it lies in a context
of length - k symbols to both sides.

1. One pass emits (anchor, context, doc) hashes; a shuffle by anchor finds
   contexts that were seen in a smaller doc_id (all their windows repeat) and
   anchors with several contexts, whose windows may repeat in part.
2. For the latter, only the first document of every distinct context sends its
   symbols, joined into runs and dealt by the first document of the anchor, to
   groups.  A matcher (suffix automaton or suffix array) finds the windows that
   an earlier document of the group holds.
3. A group with more than `cap` bytes is not held in a task: its windows are
   hashed to 128 bits and their least owner is found by an aggregation.  So are
   the windows of an anchor with many contexts in one piece of text, a passage
   that goes through large parts of the corpus; such an anchor's contexts bypass
   its task, and rows of equal contexts are combined before the shuffle.
4. An anchor that goes through so many pieces that its rows would weigh on one
   task (frequent(), counted in a part of the texts) is dealt by its contexts,
   each over SALTS tasks, from every piece; the first document of a context in
   each of these tasks sends its symbols to the aggregation of 3.

Any window that any two documents share has one anchor, hence one group, and
some first document sends it there: no repeat is lost, and every repeat found is
a real one (step 1 up to 64-bit collisions of contexts).  What a document is told
and what it loses goes by rid, the number of its row, since doc_ids can be equal
or null; doc_ids only tell which document is earlier.  A null doc_id counts as
2^63 - 1, so that no other is larger; rows with equal doc_ids never remove each other's
symbols, and each of them is a first document of its contexts.  Windows that
repeat in one row are found in that row alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as t
from .common import staged

LAST = (1 << 63) - 1
BATCH, CAP = 1 << 18, 1 << 19
HOT = 16  # contexts of an anchor in a piece of text, one for each row of equal doc_ids; an anchor with more belongs to no group, but to the aggregation
WIDE = -(1 << 63)
OFTEN = 1000
SHARE, MANY, PER_TASK, SALTS = 16, 1024, 10, 64  # frequent anchors: in one of SHARE texts, MANY rows and over 1 / PER_TASK of a task's; they only change where rows are dealt


class Unit(NamedTuple):
    """How texts are cut into symbols and which windows are looked for."""

    words: bool
    length: int
    k: int
    within: bool  # whether a window also repeats one that starts earlier in its own document


class Cut(NamedTuple):
    """The symbols of a piece of a batch: prefix sums for hashing, first symbol of each document, byte span of each symbol (words only), the symbols (bytes only)."""

    prefix: np.ndarray
    roller: t.Roller
    first: np.ndarray
    start: np.ndarray | None
    end: np.ndarray | None
    symbols: np.ndarray | None


class Anchors(NamedTuple):
    at: np.ndarray  # position among the piece's symbols
    doc: np.ndarray
    low: np.ndarray  # context
    high: np.ndarray
    anchor: np.ndarray  # hashes
    context: np.ndarray


def cut(unit: Unit, buf: np.ndarray, offsets: np.ndarray) -> Cut:
    if not unit.words:
        return Cut(t.BYTES.prefix(buf), t.BYTES, offsets, None, None, buf)
    start, end, first = t.words(buf, offsets, t.NOT_SPACE)
    return Cut(t.WORDS.prefix(t.word_hashes(buf, start, end)), t.WORDS, first, start, end, None)


def anchors(unit: Unit, c: Cut) -> Anchors:
    grams, w = c.roller.grams(c.prefix, unit.k), unit.length - unit.k + 1
    _, at = t.winnow(grams, np.where(t.inside(c.first, unit.length), w, 0)[: len(grams)], w)
    at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
    doc = np.searchsorted(c.first, at, "right") - 1
    low, high = np.maximum(c.first[doc], at - (unit.length - unit.k)), np.minimum(c.first[doc + 1], at + unit.length)
    return Anchors(at, doc, low, high, grams[at].view(np.int64), t.mix(c.roller.spans(c.prefix, low, high) + (at - low).astype(np.uint64)).view(np.int64))


def _anchor_counts(unit: Unit):
    """Rows (anchor, n) of a piece: the anchor's distinct contexts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offsets in t.chunks(batch.column("text")):
                a = anchors(unit, cut(unit, buf, offsets))
                first = np.unique(a.context, return_index=True)[1]
                anchor, n = np.unique(a.anchor[first], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(n, pa.int64())], names=["anchor", "n"])

    return run


def frequent(docs: DataFrame, unit: Unit, parts: int) -> np.ndarray:
    """Anchors, sorted, with over 1 / (PER_TASK * parts) of the rows of all that have MANY in the counted texts: fewer than PER_TASK * parts, however large the corpus.

    Any set of anchors gives the same results; one that the counted texts miss
    stays below what they can miss, and its task gets longer by so much.
    """
    some = docs.filter(F.pmod(F.xxhash64("rid"), F.lit(SHARE)) == 0).select("text")
    counts = some.mapInArrow(_anchor_counts(unit), "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
    counts = staged(counts.filter(F.col("n") >= MANY))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.filter(F.col("n") * (PER_TASK * parts) > total).select("anchor").collect() if total else []
    return np.sort(np.array([r.anchor for r in rows], np.int64))


def _anchor_rows(unit: Unit, often: np.ndarray):
    """Rows (key, anchor, kind, context, doc_id, rid) of a batch, combined before they are shuffled by key; often: sorted anchors.

    kind 1: a first document of a context in its piece, dealt by anchor.
    kind 2: a later document of the context; it is known already, and dealt by itself.
    kind 3: a first document of an anchor with over HOT of them in the piece, dealt by itself.
    kind 0: tells the other documents of such an anchor so, once for a piece.
    kind 4: a first document of a context of an anchor that is often met, dealt by the context and one of SALTS numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rids = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("doc_id", "rid"))
            for low, _, buf, offsets in t.chunks(batch.column("text")):
                a = anchors(unit, cut(unit, buf, offsets))
                owner, rid = ids[low + a.doc], rids[low + a.doc]
                order = np.lexsort((rid, owner, a.context))
                ctx, own, rid = a.context[order], owner[order], rid[order]
                new = np.r_[True, ctx[1:] != ctx[:-1]] if len(ctx) else np.zeros(0, bool)
                fresh = new | np.r_[True, rid[1:] != rid[:-1]] if len(ctx) else new
                head = own[np.maximum.accumulate(np.where(new, np.arange(len(ctx)), 0))] if len(ctx) else own
                anchor = a.anchor[order]
                firsts = fresh & (own == head)
                _, at, n = np.unique(anchor[firsts], return_inverse=True, return_counts=True)
                hot = np.zeros(len(ctx), bool)
                hot[firsts] = n[at] > HOT
                met = _find(anchor, often) >= 0
                kind = np.where(own > head, 2, np.where(met, 4, np.where(hot, 3, 1)))
                rows = np.flatnonzero(fresh)
                marks = np.unique(anchor[hot & ~met])
                dealt = np.where(kind == 4, t.mix(rid.view(np.uint64)) % t.U(SALTS), rid.view(np.uint64))
                key = np.where(kind == 1, anchor, t.mix(ctx.view(np.uint64) ^ dealt).view(np.int64))
                none = np.zeros(len(marks), np.int64)
                out = [np.r_[x[rows], y] for x, y in ((key, marks), (anchor, marks), (kind, none), (ctx, none), (own, none), (rid, none))]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 2 else pa.int64()) for i, x in enumerate(out)], names=["key", "anchor", "kind", "context", "doc_id", "rid"])

    return run


def _told_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, kind, context, doc_id and rid; what documents need to be told: (rid, context, owner).

    owner null: the context is known from a smaller doc_id.  Else: the document
    is a first one of the context, and the anchor, whose group is `owner`, has
    other contexts (WIDE: or is met too often for a group).  However many rows an anchor has, no more are remembered
    than the rids of its first context's first documents, of equal doc_ids.
    """
    anchor = context = least = owner = often = None
    waiting: list[int] = []  # the anchor's first rows, while its first context is the only one
    for batch in batches:
        a, k, c, d, r = (batch.column(x).to_numpy() for x in ("anchor", "kind", "context", "doc_id", "rid"))
        if not len(a):
            continue
        same = a[1:] == a[:-1]
        edge = np.zeros(len(a), bool)
        edge[[0, -1]] = True
        met = np.flatnonzero(np.r_[False, same] | np.r_[same, False] | edge | (k != 1))  # rows whose anchor may be another row's, too
        out: list[tuple] = []
        for x, kind, y, z, rid in zip(a[met].tolist(), k[met].tolist(), c[met].tolist(), d[met].tolist(), r[met].tolist(), strict=True):
            if kind == 4:
                often = often if often and often[:2] == (x, y) else (x, y, z)
                out.append((rid, y, None if z > often[2] else WIDE))
            elif kind > 1:
                out.append((rid, y, None if kind == 2 else WIDE))
            elif kind == 0:
                anchor, context, owner, waiting = x, None, WIDE, []
            elif x != anchor:
                anchor, context, least, owner, waiting = x, y, z, rid, [rid]
            elif y != context:
                out += [(w, context, owner) for w in waiting]
                out.append((rid, y, owner))
                context, least, waiting = y, z, []
            elif z > least:
                out.append((rid, y, None))
            elif waiting:
                waiting.append(rid)
            else:
                out.append((rid, y, owner))
        yield pa.RecordBatch.from_arrays([pa.array([v[j] for v in out], pa.int64()) for j in range(3)], names=["rid", "context", "owner"])


def _find(contexts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each context its index in the sorted wanted ones, or -1."""
    if not len(wanted):
        return np.full(len(contexts), -1)
    i = np.minimum(np.searchsorted(wanted, contexts), len(wanted) - 1)
    return np.where(wanted[i] == contexts, i, -1)


def _span_rows(unit: Unit):
    """Runs of ambiguous contexts of one owner: (owner, doc_id, rid, at, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rids, asked = batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist(), batch.column("asked")
            out: list[tuple] = []
            for low, high, buf, offsets in t.chunks(batch.column("text")):
                c = cut(unit, buf, offsets)
                a = anchors(unit, c)
                by = np.searchsorted(a.doc, np.arange(high - low + 1))
                for i in range(high - low):
                    want = asked[low + i].values
                    ctx, own = want.field(0).to_numpy(), want.field(1).to_numpy()
                    order = np.argsort(ctx, kind="stable")
                    ctx, own = ctx[order], own[order]
                    mine = slice(by[i], by[i + 1])
                    at = _find(a.context[mine], ctx)
                    hit = np.flatnonzero(at >= 0)
                    if unit.within:  # later places of a context in a document go in any case
                        hit = hit[np.unique(at[hit], return_index=True)[1]]
                    owners = own[at[hit]]
                    for x in np.unique(owners):
                        h = hit[owners == x] + by[i]
                        for s, e in zip(*(v.tolist() for v in t.merge_spans(a.low[h], a.high[h])), strict=True):
                            content = buf[s:e] if not unit.words else buf[c.start[s] : c.end[e - 1]]
                            out.append((int(x), ids[low + i], rids[low + i], s - int(c.first[i]), content.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.binary() if j == 4 else pa.int64()) for j in range(5)], names=["owner", "doc_id", "rid", "at", "content"])

    return run


Span = tuple[int, int, bytes]  # doc_id, position of its first symbol, content
Matcher = Callable[..., list[tuple[int, int, int]]]  # spans, rows=the rid of each -> (rid, first symbol, past the last symbol) to remove


def _match_rows(match: Matcher):
    """Rows sorted by owner; groups are matched together up to BATCH bytes, a larger group (of CAP at most) alone."""

    def rows(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda s: s[:3])
        found = match([(d, at, content) for d, _, at, content in held], rows=[s[1] for s in held])
        return pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(3)], names=["rid", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, group, size, own, owner = [], [], 0, 0, None
        for batch in batches:
            for o, d, rid, at, content in zip(*(batch.column(c).to_pylist() for c in ("owner", "doc_id", "rid", "at", "content")), strict=True):
                if o != owner:
                    done, group, size, own, owner = done + group, [], size + own, 0, o
                    if size >= BATCH:
                        yield rows(done)
                        done, size = [], 0
                group.append((d, rid, at, content))
                own += len(content)
        if done or group:
            yield rows(done + group)

    return run


def _window_rows(unit: Unit):
    """The distinct windows of spans, hashed twice: (h, g, doc_id, rid, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rids, places = (batch.column(x).to_numpy() for x in ("doc_id", "rid", "at"))
            for low, high, buf, offsets in t.chunks(batch.column("content")):
                c = cut(unit, buf, offsets)
                n = int(c.first[-1])
                symbols = t.OTHER.spans(t.OTHER.prefix(buf), c.start, c.end) if unit.words else buf
                at = np.flatnonzero(t.left_in_document(c.first, unit.length)[:n] > 0)
                if not len(at):
                    continue
                doc = np.searchsorted(c.first, at, "right") - 1
                h, g = c.roller.spans(c.prefix, at, at + unit.length), t.OTHER.spans(t.OTHER.prefix(symbols), at, at + unit.length)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(ids[low + doc]), pa.array(rids[low + doc]), pa.array(places[low + doc] + at - c.first[doc])], names=["h", "g", "doc_id", "rid", "at"])

    return run


def _late(windows: DataFrame, least: DataFrame, length: int) -> DataFrame:
    """Spans (rid, start, end) of the windows that a smaller doc_id has; least(h, g, least, n), n the window's places.

    Windows with over 1 / OFTEN of all places, fewer than OFTEN of them, are looked
    up in a broadcast table of that bound, so that their places stay where they
    are; the others meet theirs in a shuffle.
    """
    total = least.agg(F.sum("n")).first()[0] or 0
    wide = F.col("n") * OFTEN > total
    often = F.broadcast(least.filter(wide).select("h", "g", F.col("least").alias("known")))
    marked = windows.join(often, ["h", "g"], "left")
    met = marked.filter("known IS NULL").drop("known").join(least.filter(~wide).select("h", "g", F.col("least").alias("known")), ["h", "g"])
    late = marked.filter("known IS NOT NULL").unionByName(met).filter("doc_id > known")
    return late.select("rid", F.col("at").alias("start"), (F.col("at") + length).alias("end"))


def repeats(docs: DataFrame, unit: Unit, match: Matcher, cap: int = CAP) -> DataFrame:
    """(rid, known, spans): contexts known from smaller doc_ids, and further spans to remove; docs(rid, doc_id, text), a table whose rids stay the same when it is read again."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select("rid", F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text")
    seen = docs.mapInArrow(_anchor_rows(unit, frequent(docs, unit, parts)), "key bigint, anchor bigint, kind int, context bigint, doc_id bigint, rid bigint")
    told = seen.repartition(parts, "key").drop("key").sortWithinPartitions("anchor", "kind", "context", "doc_id", "rid").mapInArrow(_told_rows, "rid bigint, context bigint, owner bigint")
    told = staged(told)
    asked = told.filter("owner IS NOT NULL").groupBy("rid").agg(F.collect_list(F.struct("context", "owner")).alias("asked"))
    spans = staged(docs.join(asked, "rid").mapInArrow(_span_rows(unit), "owner bigint, doc_id bigint, rid bigint, at bigint, content binary"))
    wide = F.col("owner") == WIDE
    sizes = spans.filter(~wide).groupBy("owner").agg(F.sum(F.length("content")).alias("bytes"))
    large = staged(sizes.filter(F.col("bytes") > cap).select("owner"))
    dealt = spans.filter(~wide).join(large, "owner", "left_anti").repartition(parts, "owner").sortWithinPartitions("owner")
    found = dealt.mapInArrow(_match_rows(match), "rid bigint, start bigint, end bigint")
    windows = spans.join(large, "owner", "left_semi").unionByName(spans.filter(wide)).mapInArrow(_window_rows(unit), "h bigint, g bigint, doc_id bigint, rid bigint, at bigint")
    least = windows.groupBy("h", "g").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).filter("least <> most").drop("most")
    late = _late(windows, staged(least), unit.length)
    removed = found.unionByName(late).groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    known = told.filter("owner IS NULL").groupBy("rid").agg(F.collect_list("context").alias("known"))
    return known.join(removed, "rid", "full_outer")


def _again(unit: Unit, c: Cut, a: Anchors, part: slice) -> np.ndarray:
    """Windows of a document (their first symbols) that it has before, of those in the first places of its contexts.

    Equal windows have equal anchors, so only anchors with several contexts are looked at.
    """
    at = np.sort(np.unique(a.context[part], return_index=True)[1]) + part.start
    _, back, n = np.unique(a.anchor[at], return_inverse=True, return_counts=True)
    at = at[n[back] > 1]
    if not len(at):
        return at
    low, high = t.merge_spans(a.low[at], a.high[at])
    p = np.concatenate([np.arange(x, y - unit.length + 1) for x, y in zip(low.tolist(), high.tolist(), strict=True)])
    h, base = c.roller.spans(c.prefix, p, p + unit.length), int(low[0])
    g = t.OTHER.spans(t.OTHER.prefix(c.symbols[base : int(high[-1])]), p - base, p - base + unit.length)
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    return np.sort(p[order[np.r_[False, (h[1:] == h[:-1]) & (g[1:] == g[:-1])]]])


def recurring(unit: Unit, a: Anchors, docs: int) -> np.ndarray:
    """For each document of a piece whether it may hold a window twice: equal windows have equal anchors."""
    out = np.zeros(docs, bool)
    if unit.within and len(a.at):
        order = np.lexsort((a.anchor, a.doc))
        doc, anchor = a.doc[order], a.anchor[order]
        out[doc[1:][(doc[1:] == doc[:-1]) & (anchor[1:] == anchor[:-1])]] = True
    return out


NONE = np.zeros(0, np.int64)


def removal(unit: Unit, c: Cut, a: Anchors, i: int, part: slice, known: np.ndarray | None, spans: np.ndarray | None, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans of a document's symbols to remove: `known` contexts, `spans` rows (start, end), and, `within`, what it has before itself."""
    if known is None and spans is None and not within:
        return NONE, NONE
    spans = np.zeros((0, 2), np.int64) if spans is None else spans
    ctx = a.context[part]
    hit = _find(ctx, np.sort(known)) >= 0 if known is not None else np.zeros(len(ctx), bool)
    if within and len(ctx):
        order = np.argsort(ctx, kind="stable")
        hit[order[np.r_[False, ctx[order][1:] == ctx[order][:-1]]]] = True
    again = _again(unit, c, a, part) if within else NONE
    base = int(c.first[i])
    low, high = np.r_[a.low[part][hit], again] - base, np.r_[a.high[part][hit], again + unit.length] - base
    return t.merge_spans(np.r_[low, spans[:, 0]], np.r_[high, spans[:, 1]])
