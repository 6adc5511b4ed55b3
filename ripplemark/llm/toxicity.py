"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts to Latin ones,
digits that stand between letters to the letters they imitate, and everything
that is no letter to a space.  The lexicon holds whole words and beginnings of
words, learned as those far more common in toxic labelled documents than in
others, weighted by their log odds.  A document's matches are found in one
pass of an Aho-Corasick automaton; a match inside an exception phrase does not
count; the weights are summed and normalised by the document's length, and a
logistic curve, fitted on the same labelled rows, turns sum and density into a
score.

The fit uses about SAMPLE labelled doc_ids at most, those of least hash among the
ones that are not held out, and one text of each; every entry of the lexicon is in
SEEN of their toxic ones at least, which bounds its size.

Defined results: null and empty texts have no matches and the score of a text
without any; without labels the lexicon is empty and every score is 0.5;
conflicting labels of a doc_id count with their mean, rounded; equal doc_ids are
separate rows; very long texts are matched whole, one at a time in a task; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, held_out, sampled, staged, table

SAMPLE = 20_000
STEMS = (4, 5)
SEEN, ODDS = 3, 3.0
THRESHOLD = 0.5

# Letters of other scripts that look like Latin ones, digits that stand for letters, and harmless phrases with words often used as abuse.
LOOK_ALIKES = dict(zip("аеорсхуіјѕԁһӏкмтвнαοερτυικνχ", "aeopcxyijsdhlkmtbhaoeptuiknx", strict=True))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pathetic fallacy", "pond scum", "scum line", "sore loser rule")

_FOLD = str.maketrans(LOOK_ALIKES | {chr(0xFF21 + i): chr(0x61 + i) for i in range(26)} | {chr(0xFF41 + i): chr(0x61 + i) for i in range(26)})
_LEET = re.compile(r"(?<=[^\W\d_])[013457-9]+(?=[^\W\d_])|\b[013457-9](?=[^\W\d_]{2})")
_WORDS = re.compile(r"[^\W\d_]+")
_DIGITS = str.maketrans(DIGITS)


def fold(text: str | None) -> list[str]:
    """The words of a text after folding."""
    text = (text or "").lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    return _WORDS.findall(_LEET.sub(lambda m: m[0].translate(_DIGITS), text))


class Lexicon(NamedTuple):
    """Weights of whole words (" word ") and of beginnings (" stem"), exception phrases, and the curve's coefficients."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            found.add_word(entry, (len(entry), w))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        found.make_automaton()
        return found


def _features(words: list[str], automaton: ahocorasick.Automaton) -> tuple[float, float]:
    """Sum of the weights of matched words, each word once by its best entry, and that sum per hundred words."""
    if not len(automaton):
        return 0.0, 0.0
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, w) in automaton.iter(f" {' '.join(words)} "):
        start = end - size + 1
        if w is None:
            spared.append((start, end))
        elif w > best.get(start, 0.0):
            best[start] = w
    if spared:
        spared.sort()
        begins, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
        best = {at: w for at, w in best.items() if not ((i := bisect_right(begins, at)) and at < reach[i - 1])}
    total = sum(best.values())
    return total, 100 * total / max(1, len(words))


def _entries(words: list[str]) -> set[str]:
    found = set(words)
    return {f" {w} " for w in found} | {f" {w[:n]}" for w in found for n in STEMS if len(w) > n}


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other documents of a batch hold each entry, and their numbers under an empty entry."""
    for batch in batches:
        toxic, other = Counter(), Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            (toxic if label >= 0.5 else other).update({""} | _entries(fold(text)))
        keys = list(toxic | other)
        yield pa.RecordBatch.from_pydict({"entry": pa.array(keys, pa.string()), "toxic": pa.array([toxic[k] for k in keys], pa.int64()), "other": pa.array([other[k] for k in keys], pa.int64())})


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression on (1, log sum, log density) by Newton steps."""
    if not len(y):
        return 0.0, 0.0, 0.0
    z = np.column_stack([np.ones(len(y)), np.log1p(x)])
    w = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        r = np.array([1e-6, 1e-2, 1e-2])
        w = w - np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(r + 1e-9), z.T @ (p - y) + r * w)
    return tuple(w.tolist())


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learn from about `sample` labelled rows at most of docs(doc_id, text) that are not held out; labels(doc_id, label)."""
    spark = docs.sparkSession
    labels = labels.filter("label IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.round(F.avg("label")).alias("label"))
    rows = docs.join(F.broadcast(staged(sampled(labels, "doc_id", sample))), "doc_id")
    rows = staged(rows.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("text", "label"))
    counts = rows.mapInArrow(_count_rows, "entry string, toxic bigint, other bigint").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = staged(counts)
    base = counts.filter("entry = ''").first()
    n, m = (base.toxic, base.other) if base else (0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (n + 1)) - F.log((F.col("other") + 0.5) / (m + 1))
    kept = counts.filter((F.col("entry") != "") & (F.col("toxic") >= SEEN)).withColumn("odds", odds).filter(F.col("odds") >= ODDS).orderBy("entry").collect()
    weights = {r.entry: r.odds for r in kept}
    # a beginning is kept for words that vary after it, not where one whole word accounts for most of it
    seen = {r.entry: r.toxic for r in kept}
    for word in [e for e in weights if e.endswith(" ")]:
        for stem in (word[: n + 1] for n in STEMS):
            if stem in weights and 2 * seen[word] >= seen[stem]:
                del weights[stem]
    lexicon = Lexicon(weights, exceptions if weights else (), (0.0, 0.0, 0.0))
    shared = spark.sparkContext.broadcast(lexicon)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in batches:
            x = [_features(fold(text), automaton) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"total": pa.array([a for a, _ in x], pa.float64()), "density": pa.array([b for _, b in x], pa.float64()), "label": batch.column("label")})

    x = rows.mapInArrow(features, "total double, density double, label double").toPandas()
    return lexicon._replace(curve=_fit_curve(x[["total", "density"]].to_numpy(float), x["label"].to_numpy(float)))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, total, density) for every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, (a, b, c) = shared.value.automaton(), shared.value.curve
        for batch in batches:
            x = np.array([_features(fold(v.as_py()), automaton) for v in batch.column("text")], float).reshape(-1, 2)
            s = 1 / (1 + np.exp(-np.clip(a + b * np.log1p(x[:, 0]) + c * np.log1p(x[:, 1]), -30, 30)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(s), "total": pa.array(x[:, 0]), "density": pa.array(x[:, 1])})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, total double, density double")


def op3_lexicon_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = columns(table(spark, sf_dir, "documents"), doc_id="long", text="string"), columns(table(spark, sf_dir, "labels"), doc_id="long", toxic="double")
    out = score(docs, learn(docs, labels.withColumnRenamed("toxic", "label")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
