"""Near-duplicates by SuperMinHash, banding, verification and union-find.

A document is the set of its word shingles.  Per element SuperMinHash draws
ranks r + j in the order of a random permutation of the signature's places, so
that an element's ranks are correlated and spread over different places; a set
stops at step j as soon as all its places hold less than j, which no later step
can lower.  Steps run over all sets of a piece of text at once.

Equal sets are one class.  The signature is cut into BANDS bands; classes that
agree in one meet under its key, and those whose signatures agree in enough
places are joined by union-find, so that a key emits at most a link less than
it has classes.  The groups that this gives are wider than the wanted ones;
inside each, full sets are compared until every class has met every class that
it is not joined with yet, and union-find keeps links that span what they join.

A key or group with over BLOCK classes, or over WEIGHT bytes of sets, is cut
into blocks, and every pair of blocks is a task of its own.

Two sets of a similarity of exactly 0.85 share none of the 25 bands of 5 places
with a chance of 4e-7, and agree in less than 0.65 of the places (six standard
deviations) with one of 1e-8; more similar ones with less.

Defined results: null, empty and blank texts have an empty set and are linked
with nothing; a text of fewer words than a shingle has one shingle, all its
words; a null doc_id sorts after all others; equal doc_ids are separate rows;
very long texts are taken whole, one at a time; an empty table gives no rows.
Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as t
from .common import columns, small, staged, table
from .components import components

SHINGLE, SHARE = 3, (85, 100)
BANDS, ROWS = 25, 5
PLACES = BANDS * ROWS

#: Share of agreeing places from which two classes' full sets are compared.
LIKELY = 0.65

#: Classes, and bytes of sets, that a block holds on average.
BLOCK, WEIGHT = 2048, 16 << 20

U = np.uint64
STEP = 0x9E3779B97F4A7C15  # between the draws of an element


def _step(k: int) -> np.uint64:
    return U(STEP * k % (1 << 64))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """For each document in the bytes the sorted distinct hashes of its shingles."""
    buf = t.FOLD[buf]
    start, end, first = t.words(buf, offsets, t.NOT_SPACE)
    prefix = t.WORDS.prefix(t.word_hashes(buf, start, end))
    grams = t.WORDS.grams(prefix, shingle)
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = high - low
        if n >= shingle:
            out.append(np.unique(grams[low : high - shingle + 1]))
        else:
            out.append(t.WORDS.spans(prefix, np.array([low]), np.array([high])) if n else np.zeros(0, U))
    return out


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """SuperMinHash of each set, a row each: the 53-bit ranks as doubles; empty sets keep infinity."""
    sizes = np.array([len(s) for s in sets], np.int64)
    best = np.full((len(sets), places), np.inf)
    flat = best.ravel()
    owner, state = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets) if sets else np.zeros(0, U)
    order = None
    for j in range(places):
        if not len(owner):
            break
        draw = t.mix(state + _step(2 * j + 1))
        rank = (draw >> U(11)).astype(np.float64) * 2.0**-53
        pick = j + (t.mix(state + _step(2 * j + 2)) % U(places - j)).astype(np.int64)
        if order is None:
            at = pick  # the first place of a permutation that nothing has changed yet
        else:
            rows = np.arange(len(owner))
            at = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, j]
        np.minimum.at(flat, owner * places + at, rank + j)
        open_ = best.max(axis=1) > j + 1  # what comes is j + 1 or more
        keep = open_[owner]
        if not keep.all():
            owner, state, pick = owner[keep], state[keep], pick[keep]
            order = None if order is None else order[keep]
        if order is None and len(owner):
            order = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (len(owner), 1))
            order[np.arange(len(owner)), pick] = 0
            order[:, 0] = pick
    return best


def _name(own: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    d = xxhash.xxh3_128_intdigest(own.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, the class's name (null for empty sets), and the signature, a byte a place, with a hash of each band's full ranks behind."""
    factors = np.array([_step(2 * k + 1) for k in range(ROWS)])
    for batch in batches:
        for low, high, buf, offsets in t.chunks(batch.column("text")):
            sets = shingle_sets(buf, offsets)
            ranks = signatures(sets)
            hashes = t.mix(ranks.view(U))
            places = (hashes & U(255)).astype(np.uint8)
            bands = t.mix((hashes.reshape(len(sets), BANDS, ROWS) * factors).sum(axis=2, dtype=U)).view(np.int64)
            full = [len(s) > 0 for s in sets]
            names = [_name(s) if f else (None, None) for s, f in zip(sets, full, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(low, high - low),
                    batch.column("text_a").slice(low, high - low),
                    batch.column("text_b").slice(low, high - low),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([n[0] for n in names], pa.int64()),
                    pa.array([n[1] for n in names], pa.int64()),
                    pa.array([p.tobytes() if f else None for p, f in zip(places, full, strict=True)], pa.binary()),
                    pa.array([b.tolist() if f else None for b, f in zip(bands, full, strict=True)], pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_a", "text_b", "n", "a", "b", "places", "bands"],
            )


def _agree(places: np.ndarray, i: int, among: np.ndarray) -> np.ndarray:
    """Those of `among` whose signatures agree with the i-th's in LIKELY of the places, chance agreement of a byte taken off."""
    same = (places[among] == places[i]).sum(axis=1) / places.shape[1]
    return among[(same - 1 / 256) / (1 - 1 / 256) >= LIKELY]


def _near(sets: list[np.ndarray], i: int, among: np.ndarray, share: tuple[int, int] = SHARE) -> np.ndarray:
    """Those of `among` whose full sets share enough with the i-th's."""
    own = sets[i]
    lens = np.array([len(sets[j]) for j in among], np.int64)
    fits = share[1] * np.minimum(lens, len(own)) >= share[0] * np.maximum(lens, len(own))
    among, lens = among[fits], lens[fits]
    if not len(among):
        return among
    other = np.concatenate([sets[j] for j in among])
    at = np.searchsorted(own, other)
    hit = own[np.minimum(at, len(own) - 1)] == other
    common = np.add.reduceat(hit.astype(np.int64), np.r_[0, np.cumsum(lens)[:-1]])
    return among[share[1] * common >= share[0] * (len(own) + lens - common)]


def spanning(places: np.ndarray, sets: list[np.ndarray] | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the parts of a group, by signatures or, with sets, by these; with `side`, only pairs of different sides are compared.

    Every class meets, once, all classes that are not in its part by then.
    """
    n = len(places)
    parts, links = np.arange(n), []
    for i in range(n):
        among = np.flatnonzero((parts != parts[i]) & (np.arange(n) > i))
        if side is not None:
            among = among[side[among] != side[i]]
        if not len(among):
            continue
        close = _agree(places, i, among)
        if sets is not None and len(close):
            close = _near(sets, i, close)
        for j in close.tolist():
            if parts[j] != parts[i]:
                links.append((i, j))
                parts[parts == parts[j]] = parts[i]
    return links


def _links(with_sets: bool):
    """Links of each run of equal (g, h, low, high) in rows sorted by these."""

    def emit(held: list[dict]) -> pa.RecordBatch:
        out = ([], [], [], [])
        if len(held) > 1:
            places = np.frombuffer(b"".join(r["places"] for r in held), np.uint8).reshape(len(held), -1)
            sets = [np.frombuffer(r["elements"], U) for r in held] if with_sets else None
            side = np.array([r["side"] for r in held]) if held[0]["low"] != held[0]["high"] else None
            for i, j in spanning(places, sets, side):
                for column, v in zip(out, (held[i]["a"], held[i]["b"], held[j]["a"], held[j]["b"]), strict=True):
                    column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b", "c", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                for r in batch.slice(low, 256).to_pylist():
                    now = (r["g"], r["h"], r["low"], r["high"])
                    if now != key:
                        if len(held) > 1:
                            yield emit(held)
                        held, key = [], now
                    held.append(r)
        if len(held) > 1:
            yield emit(held)

    return run


def _in_blocks(rows: DataFrame, places: DataFrame, block: int, weight: int, extra: str | None = None) -> DataFrame:
    """rows(g, h, a, b, ...) of keys (g, h) with two or more, dealt to pairs of blocks of their key: as (low, high) with the side of each row, and its signature from places(a, b, places)."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bytes_ = F.sum(F.octet_length(extra)) if extra else F.lit(0)
    sizes = rows.groupBy("g", "h").agg(F.count("*").alias("_n"), bytes_.alias("_w")).filter("_n > 1")
    sizes = sizes.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("_n") / block), F.ceil(F.col("_w") / weight)).cast("int")).select(F.col("g").alias("_g"), F.col("h").alias("_h"), "blocks")
    both = rows.join(sizes, (F.col("g") == F.col("_g")) & (F.col("h") == F.col("_h"))).withColumn("own", F.pmod(F.xxhash64("a", "b"), F.col("blocks")).cast("int"))
    cols = ["g", "h", "a", "b", "places", *([extra] if extra else [])]
    both = both.join(places.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "places"), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    pairs = both.select(*cols, "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    pairs = pairs.select(*cols, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
    return pairs.repartition(parts, "g", "h", "low", "high").sortWithinPartitions("g", "h", "low", "high", "a", "b")


LINKS = "a bigint, b bigint, c bigint, d bigint"


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        others = [batch.column(c) for c in ("g", "h", "a", "b")]
        for low, high, buf, offsets in t.chunks(batch.column("text")):
            sets = [s.tobytes() for s in shingle_sets(buf, offsets)]
            yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in others), pa.array(sets, pa.binary())], names=["g", "h", "a", "b", "elements"])


def cluster(docs: DataFrame, block: int = BLOCK, weight: int = WEIGHT) -> DataFrame:
    """(doc_id, n_shingles, component_id, component) for every row of docs(doc_id, text).

    component names a group of linked rows and is not null; component_id is its least doc_id, null where it has none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marks = (F.xxhash64("text").alias("text_a"), F.xxhash64(F.lit(1), F.col("text")).alias("text_b"))
    signed = staged(rows.select("*", *marks).mapInArrow(_signed, "doc_id bigint, text_a bigint, text_b bigint, n bigint, a bigint, b bigint, places binary, bands array<bigint>"))
    # a class is known by its set's name; its least doc_id, and one of its texts, stand for it
    full = signed.filter("n > 0")
    classes = staged(full.groupBy("a", "b").agg(F.min("doc_id").isNull().alias("none"), F.coalesce(F.min("doc_id"), F.lit(0)).alias("least"), F.min(F.struct("text_a", "text_b")).alias("text"), F.min("places").alias("places"), F.min("bands").alias("bands")))
    keyed = classes.select(F.posexplode("bands").alias("g", "h"), "a", "b").withColumn("g", F.col("g").cast("long"))
    likely = staged(_in_blocks(keyed, classes, block, weight).mapInArrow(_links(False), LINKS).distinct())
    name = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    wide = components(likely.select(name("a", "b").alias("a"), name("c", "d").alias("b")))
    wide = staged(wide.select(F.col("component.a").alias("g"), F.col("component.b").alias("h"), F.col("node.a").alias("a"), F.col("node.b").alias("b")))
    # full sets of the classes in such a group, from the text that stands for each
    asked = staged(wide.join(classes.select("a", "b", "text"), ["a", "b"]).select("g", "h", "a", "b", F.col("text.text_a").alias("_a"), F.col("text.text_b").alias("_b")))
    found = rows.select("text", *marks).join(small(asked.select("_a", "_b")), (F.col("text_a") == F.col("_a")) & (F.col("text_b") == F.col("_b")), "left_semi")
    once = found.groupBy("text_a", "text_b").agg(F.min("text").alias("text"))
    sets = asked.join(once, (F.col("text_a") == F.col("_a")) & (F.col("text_b") == F.col("_b"))).select("g", "h", "a", "b", "text")
    sets = staged(sets.mapInArrow(_elements, "g bigint, h bigint, a bigint, b bigint, elements binary"))
    linked = staged(_in_blocks(sets, classes, block, weight, "elements").mapInArrow(_links(True), LINKS))
    least = classes.select("a", "b", F.struct("none", "least", "a", "b").alias("name"))
    ends = linked.join(least.select("a", "b", F.col("name").alias("x")), ["a", "b"]).join(least.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("name").alias("y")), ["c", "d"])
    groups = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), F.col("component").alias("found"))
    named = staged(least.join(groups, ["a", "b"], "left").select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.coalesce("found", "name").alias("component")))
    linked_rows = full.select("doc_id", "n", "a", "b").join(named, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    out = linked_rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(~F.col("component.none"), F.col("component.least")).alias("component_id"), F.sha2(F.to_json("component"), 256).alias("component"))
    alone = signed.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.concat(F.lit("empty "), F.monotonically_increasing_id().cast("string")).alias("component"))
    return out.unionByName(alone)


def op13_super_minhash(spark, sf_dir: str) -> DataFrame:
    """kept is true where doc_id and component_id are equal, both null among them."""
    out = cluster(columns(table(spark, sf_dir, "documents"), doc_id="long", text="string"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
