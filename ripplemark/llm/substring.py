"""Substring dedup with suffix automata of reference shards.

Only passages that occur in several documents with different surroundings reach
a shard (see repeats.py).  A shard's automaton holds the passages of its earlier
documents; each further document is streamed through it for matching statistics
and then joins the reference.  Windows of WINDOW words whose words start in a
smaller doc_id are removed, judged on the input.

Defined results: null and empty texts have no words and stay; a null doc_id
counts as larger than all others; rows with equal doc_ids do not remove each
other's words; very long texts are read whole, one at a time in a task; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as t
from .automaton import SuffixAutomaton
from .common import columns, packed, staged, table
from .repeats import Span, Unit, anchors, cut, recurring, removal, repeats

WINDOW, K = 50, 20
UNIT = Unit(words=True, length=WINDOW, k=K, within=False)


def match(spans: list[Span], length: int = WINDOW, rows: list[int] | None = None) -> list[tuple[int, int, int]]:
    """Spans of words, sorted by document, whose windows an earlier document holds; they are named by their rows, or without these by doc_id."""
    automaton, numbers, found = SuffixAutomaton(), {}, []
    for (doc, at, content), row in zip(spans, rows or [s[0] for s in spans], strict=True):
        sequence = [numbers.setdefault(w, len(numbers)) for w in content.split()]
        ends = automaton.earlier(sequence, length, doc)
        if ends:
            e = np.array(ends)
            found += [(row, at + a, at + b) for a, b in zip(*(v.tolist() for v in t.merge_spans(e - length, e)), strict=True)]
        if len(ends) < len(sequence) - length + 1:
            automaton.add(sequence, doc)
    return found


def _kept_rows(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept, texts = [], [], [], []
            known, spans = batch.column("known"), batch.column("spans")
            for low, high, buf, offsets in t.chunks(batch.column("text")):
                c = cut(unit, buf, offsets)
                a = anchors(unit, c)
                by, twice = np.searchsorted(a.doc, np.arange(high - low + 1)), recurring(unit, a, high - low).tolist()
                raw = buf.tobytes()
                for i in range(high - low):
                    k, s = known[low + i].values, spans[low + i].values
                    s = np.column_stack([s.field(0).to_numpy(), s.field(1).to_numpy()]) if s is not None else None
                    first, words = int(c.first[i]), int(c.first[i + 1] - c.first[i])
                    start, end = removal(unit, c, a, i, slice(by[i], by[i + 1]), k.to_numpy() if k is not None else None, s, twice[i])
                    parts, last = [], 0
                    for x, y in [*zip(start.tolist(), end.tolist(), strict=True), (words, words)]:
                        if x > last:
                            parts.append(b" ".join(raw[int(c.start[first + last]) : int(c.end[first + x - 1])].split()))
                        last = y
                    rest = b" ".join(parts)
                    n.append(words)
                    gone.append(int((end - start).sum()))
                    kept.append(hashlib.sha256(rest).hexdigest())
                    texts.append(rest.decode() if gone[-1] else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), batch.column("row"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "text", "row", "n_words", "n_removed", "kept_sha256", "rest"])

    return run


def dedup(docs: DataFrame, unit: Unit = UNIT, key: str | None = None) -> DataFrame:
    """Every row of docs(doc_id, text, ...), its other columns as `row`, with n_words, n_removed, kept_sha256 and rest: the kept words joined by one space, null where none went.

    key: a column with a number for each row, the same whenever docs is read;
    without one, rows are numbered in a written copy of the table.
    """
    rid = F.col(f"`{key}`") if key else F.monotonically_increasing_id()
    rows = packed(docs, "doc_id", "text", *([key] if key else [])).select(rid.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "row")
    rows = rows if key else staged(rows)
    found = repeats(rows.select("rid", "doc_id", "text"), unit, match)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("rid").schema.fields)
    return rows.join(found, "rid", "left").select("doc_id", "text", "row", "known", "spans").mapInArrow(_kept_rows(unit), f"{own}, n_words bigint, n_removed bigint, kept_sha256 string, rest string")


def op4_automaton_substrings(spark, sf_dir: str) -> DataFrame:
    return dedup(columns(table(spark, sf_dir, "documents"), doc_id="long", text="string")).select("doc_id", "n_words", "n_removed", "kept_sha256")
