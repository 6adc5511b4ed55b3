"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of whole texts are computed in one pass.  Shallow boosted trees are
fitted on labelled rows; every path from a root to a node becomes a rule, the
conjunction of its comparisons; lasso logistic regression keeps few rules and
weighs them; and the kept rules are compiled into one Spark column expression,
which scores any table of statistics without Python.

The fit uses about SAMPLE labelled doc_ids at most, those of least hash among
the ones that are not held out.

Defined results: null and empty texts have all statistics 0 and get a score
like any other; without labels every score is 0.5; a doc_id with several labels
counts with their mean, rounded; equal doc_ids are separate rows; very long texts
are measured whole, one at a time in a task; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as t
from .common import columns, held_out, packed, sampled, staged, table, unpacked

SAMPLE = 20_000
TREES, DEPTH, RATE, LEAST = 24, 3, 0.3, 20
PENALTY = 0.002
THRESHOLD = 0.3

STATS = ("log_words", "upper", "digit", "symbol", "stop", "space", "line", "wide", "word_length", "distinct", "repeat", "alone", "tail", "doubled")
SYMBOLS = b"#$%&*+/<=>@\\^_`{|}~!"
STOPS = b".,;:?"


def _rows_stats(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of each document: shares of characters by class, and of words by length and repetition."""
    n = len(offsets) - 1
    size = np.maximum(1, np.diff(offsets)).astype(float)
    kind = np.zeros(256, np.uint8)
    for c, group in enumerate((range(0x41, 0x5B), range(0x30, 0x3A), SYMBOLS, STOPS, b" \t\r\x0b\x0c", b"\n", range(0xC0, 0x100)), 1):
        kind[list(group)] = c
    owner = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(owner * 8 + kind[buf], minlength=8 * n).reshape(n, 8)[:, 1:] / size[:, None]
    start, end, first = t.words(buf, offsets, t.NOT_SPACE)
    words = np.diff(first)
    some = np.maximum(1, words).astype(float)
    h, doc = t.word_hashes(buf, start, end), t.owners(first)
    order = np.lexsort((h, doc))
    fresh = np.r_[True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])] if len(h) else np.zeros(0, np.bool_)
    distinct = np.bincount(doc[order][fresh], minlength=n)
    again = np.r_[False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])] if len(h) else np.zeros(0, np.bool_)
    bare = kind[buf[start]] == 3 if len(h) else np.zeros(0, np.bool_)
    tail = kind[buf[end - 1]] == 3 if len(h) else np.zeros(0, np.bool_)
    pair = tail & (end - start > 1) & (kind[buf[np.maximum(0, end - 2)]] == 3) if len(h) else tail
    by = lambda flags: np.bincount(doc, weights=flags, minlength=n) / some
    return np.column_stack([np.log1p(words), counts, by(end - start), distinct / some, by(again), by(bare & (end - start == 1)), by(tail), by(pair)])


def _stats_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, buf, offsets in t.chunks(batch.column("text")):
            x = _rows_stats(buf, offsets)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(low, high - low) for i in range(batch.num_columns)), *(pa.array(x[:, j]) for j in range(x.shape[1]))], names=[*batch.schema.names, *STATS])


def statistics(docs: DataFrame) -> DataFrame:
    """The statistics of docs(text), beside all columns that it has."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_stats_rows, f"{own}, {', '.join(f'{s} double' for s in STATS)}")


class Rule(NamedTuple):
    """A conjunction of (statistic, whether at most, threshold), and its weight."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float

    def column(self) -> F.Column:
        out = F.lit(True)
        for name, most, limit in self.tests:
            out = out & ((F.col(name) <= limit) if most else (F.col(name) > limit))
        return out.cast("double") * self.weight


class Rules(NamedTuple):
    bias: float
    rules: tuple[Rule, ...]

    def column(self) -> F.Column:
        total = F.lit(self.bias)
        for rule in self.rules:
            total = total + rule.column()
        return 1 / (1 + F.exp(-total))


def _tree(x: np.ndarray, cuts: list[np.ndarray], bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int) -> tuple[list[tuple], np.ndarray]:
    """A regression tree on gradients: the paths to all nodes but the root, and the fitted values."""
    paths, value = [], np.zeros(len(grad))

    def grow(rows: np.ndarray, path: tuple) -> None:
        g, h = grad[rows], hess[rows]
        best = (1e-6, None)
        if len(path) < depth and len(rows) >= 2 * LEAST:
            base = g.sum() ** 2 / (h.sum() + 1)
            for j, cut in enumerate(cuts):
                if not len(cut):
                    continue
                b = bins[rows, j]
                gs, hs, ns = (np.cumsum(np.bincount(b, weights=w, minlength=len(cut) + 1))[:-1] for w in (g, h, None))
                ok = (ns >= LEAST) & (ns <= len(rows) - LEAST)
                gain = np.where(ok, gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - base, -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, k))
        if best[1] is None:
            value[rows] = -g.sum() / (h.sum() + 1)
            return
        j, k = best[1]
        left = bins[rows, j] <= k
        for side, most in ((rows[left], True), (rows[~left], False)):
            paths.append(step := (*path, (j, most, float(cuts[j][k]))))
            grow(side, step)

    grow(np.arange(len(grad)), ())
    return paths, value


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = STATS, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Rules:
    """Rules from boosted trees, weighed by lasso logistic regression."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Rules(float(np.log(p / (1 - p))), ())
    cuts = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)))
        cuts.append((q[1:] + q[:-1]) / 2)
    bins = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    raw, paths = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        own, value = _tree(x, cuts, bins, p - y, p * (1 - p), depth)
        raw = raw + RATE * value
        paths |= dict.fromkeys(own)
    tests = list(paths)
    z = np.column_stack([np.all([(x[:, j] <= c) if most else (x[:, j] > c) for j, most, c in path], axis=0) for path in tests]).astype(float) if tests else np.zeros((len(y), 0))
    keep = np.unique(z, axis=1, return_index=True)[1] if z.shape[1] else []  # rules that say the same
    z, tests = z[:, keep], [tests[k] for k in keep]
    bias, w = _lasso(z, y, penalty)
    return Rules(bias, tuple(Rule(tuple((names[j], most, c) for j, most, c in path), float(v)) for path, v in zip(tests, w, strict=True) if v))


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for the mean logistic loss plus penalty times the sum of absolute weights."""
    n, d = z.shape
    rate = 4 * n / max(1e-9, np.linalg.norm(np.column_stack([z, np.ones(n)]), 2) ** 2)
    w, b = np.zeros(d), float(np.log(y.mean() / (1 - y.mean())))
    v, c, s = w.copy(), b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(z @ v + c))) - y
        w2 = v - rate * (z.T @ r) / n
        w2 = np.sign(w2) * np.maximum(0, np.abs(w2) - rate * penalty)
        b2, s2 = c - rate * r.mean(), (1 + (1 + 4 * s * s) ** 0.5) / 2
        v, c = w2 + (s - 1) / s2 * (w2 - w), b2 + (s - 1) / s2 * (b2 - b)
        w, b, s = w2, b2, s2
    return b, w


def chosen(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row for each labelled doc_id that is not held out, about `sample` of them at most."""
    known = labels.filter("label IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    return sampled(known.groupBy("doc_id").agg(F.round(F.avg("label")).alias("label")), "doc_id", sample)


def learn(stats: DataFrame, known: DataFrame, penalty: float = PENALTY) -> Rules:
    """Fit on the rows of chosen labels; of rows with one doc_id, that of least statistics, so that no more are fetched than labels are chosen."""
    rows = stats.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(*STATS)).alias("s")).select("s.*", "label")
    rows = rows.toPandas().sort_values([*STATS, "label"])
    return fit(rows[list(STATS)].to_numpy(float), rows["label"].to_numpy(float), penalty=penalty)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(rid, doc_id, score) for every row of docs(doc_id, text), learned from labels(doc_id, label)."""
    stats = staged(statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).drop("text").withColumn("rid", F.monotonically_increasing_id()))
    rules = learn(stats, chosen(labels, sample))
    return stats.select("rid", "doc_id", rules.column().alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that score `threshold` or more, learned from labels(doc_id, label)."""
    known = staged(chosen(labels, sample))
    rules = learn(statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known.select("doc_id")), "doc_id")), known)
    return unpacked(statistics(packed(docs, "doc_id", "text")).filter(rules.column() >= threshold), docs, "doc_id", "text")


def op1_rule_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = columns(table(spark, sf_dir, "documents"), doc_id="long", text="string"), columns(table(spark, sf_dir, "labels"), doc_id="long", quality="double")
    out = classify(docs, labels.withColumnRenamed("quality", "label"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
