"""Document fingerprints by spot signatures.

An occurrence of a common word (an anchor) starts a signature: the chain of the
next CHAIN content words at steps of DISTANCE, common words left out.  A text's
fingerprint is the set of its signatures' 32-bit hashes, written as sorted
hexadecimal; a text without any has the one signature of its whole word chain.
Likeness is the Jaccard index of two sets.  Sets whose sizes differ too much for
a wanted likeness need no comparison, which similar_pairs() uses: sets are
partitioned by length, and of each only the rarest signatures are indexed.

The query joins all documents by set length (spot_groups.py), and compares given
pairs at any likeness: each text with an edited one, whose tail is replaced by
the head of the next document, and with that document.  Documents are dealt to ranges of doc_id;
the last document of a range meets a copy of the first of the next.

Defined results: null texts read as empty, and two empty texts are alike (1); a
null doc_id counts as larger than all others; equal doc_ids follow each other by
falling hashes of their texts, then by falling texts; with one document, it is
its own next one; very long texts are whole, one at a time in memory; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as t
from .common import columns, staged, table

CHAIN, DISTANCE = 2, 1
LEAST = 0.8
RANGES = 4  # of doc_id, for each shuffle partition

# Common words of English, German, French and Spanish that start signatures.
COMMON = (
    "a an and are as at be by for from had has have he in is it its of on or that the this to was were which with "
    "als auf das dem den der des die ein eine er es für im in ist mit nicht sich sie und von zu "
    "au avec ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "al como con de del el en es la las lo los más no para por que se su un una y"
).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    buf = np.frombuffer(b" ".join(words), np.uint8)
    start, end, _ = t.words(buf, np.array([0, len(buf)]), t.NOT_SPACE)
    return t.word_hashes(buf, start, end)


STOP = np.sort(_hashes([w.encode() for w in sorted(set(COMMON))]))
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[b for b in range(0x21, 0x80) if not chr(b).isalnum()]] = True


def signatures(buf: np.ndarray, offsets: np.ndarray, chain: int = CHAIN, distance: int = DISTANCE) -> list[np.ndarray]:
    """The sorted distinct signature hashes of each document of a piece."""
    kind = t.NOT_SPACE & ~PUNCTUATION
    low = t.FOLD[buf]
    start, end, first = t.words(low, offsets, kind)
    h, doc = t.word_hashes(low, start, end), t.owners(first)
    common = STOP[np.minimum(np.searchsorted(STOP, h), len(STOP) - 1)] == h
    content = np.flatnonzero(~common)
    at = np.flatnonzero(common)
    begin = np.searchsorted(content, at)  # the first content word behind the anchor
    stop = begin + (chain - 1) * distance
    ok = stop < len(content)
    at, begin, stop = at[ok], begin[ok], stop[ok]
    ok = doc[content[stop]] == doc[at]
    at, begin = at[ok], begin[ok]
    sig = h[at]
    for j in range(chain):
        sig = t.mix(sig * t.U(0x9E3779B97F4A7C15) + h[content[begin + j * distance]])
    sig = (sig >> t.U(32)).astype(np.uint32)
    owner = doc[at]
    by = np.searchsorted(owner, np.arange(len(offsets)))
    prefix = t.WORDS.prefix(h)
    whole = (t.WORDS.spans(prefix, first[:-1], first[1:]) >> t.U(32)).astype(np.uint32)
    return [np.unique(sig[by[i] : by[i + 1]]) if by[i] < by[i + 1] else whole[i : i + 1] for i in range(len(offsets) - 1)]


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """The likeness of two sorted sets; 0 where it is below `least`, which their lengths alone may tell."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    likeness = common / (len(a) + len(b) - common)
    return likeness if likeness >= least else 0.0


def render(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def _one(texts: list[str]) -> list[np.ndarray]:
    return [s for low, high, buf, offsets in t.chunks(pa.array(texts, pa.string())) for s in signatures(buf, offsets)]


def _compared_rows(grouped: bool):
    """Rows (bucket, doc_id, text, own, tag, component_id) of a bucket by descending doc_id; each own row is compared with the row behind it.

    A tag is no document: it carries the group of the rows behind it that have its doc_id and text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, str, bool, int]] = []
        group = None
        for batch in batches:
            for low, high, *_ in t.chunks(batch.column("text")):
                cols = [batch.column(c).slice(low, high - low).to_pylist() for c in ("bucket", "doc_id", "text", "own", "tag", "component_id")]
                rows = held
                for b, d, x, o, tag, c in zip(*cols, strict=True):
                    if tag:
                        group = c
                    else:
                        rows.append((b, d, x or "", o, group))
                held = rows[-1:]
                out = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and a[3]]
                if not out:
                    continue
                edited = [a[2][: len(a[2]) - len(a[2]) // 2] + b[2][: len(a[2]) // 2] for a, b in out]
                sigs = _one([x[2] for x in rows])
                place = {id(x): s for x, s in zip(rows, sigs, strict=True)}
                esigs = _one(edited)
                columns = {
                    "doc_id": pa.array([a[1] for a, _ in out], pa.int64()), "n_chars": pa.array([len(a[2]) for a, _ in out], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    "fingerprint": pa.array([render(place[id(a)]) for a, _ in out], pa.string()), "edited_fingerprint": pa.array([render(s) for s in esigs], pa.string()),
                    "near_edited": pa.array([jaccard(place[id(a)], s) for (a, _), s in zip(out, esigs, strict=True)], pa.float64()),
                    "near_next": pa.array([jaccard(place[id(a)], place[id(b)]) for a, b in out], pa.float64()),
                }
                if grouped:
                    columns["component_id"] = pa.array([a[4] for a, _ in out], pa.int64())
                yield pa.RecordBatch.from_pydict(columns)

    return run


def edited(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Each row of docs(doc_id, text) compared with its edited text and with the next document, by descending doc_id.

    With groups(doc_id, text_a, component_id) of the same documents, where text_a is
    the xxhash64 of the text, each row also tells its component_id.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"none": F.col("doc_id").isNull(), "h": F.xxhash64("text")})
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = RANGES * parts
    known = F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)
    total, found = rows.agg(F.count("*"), known).first()
    bounds = sorted(set(found or []))
    # bucket 0 holds null doc_ids, bucket 1 the largest others; a bucket holds (bound, next bound], so that equal doc_ids stay together
    above = F.coalesce(F.aggregate(F.array(*[F.lit(b) for b in bounds]), F.lit(0), lambda n, b: n + (F.col("doc_id") > b).cast("int")), F.lit(0)) if bounds else F.lit(0)
    bucket = F.when(F.col("none"), 0).otherwise(F.lit(len(bounds) + 1) - above).cast("long") * (1 << 20)
    # a doc_id of more rows than a bucket should have, fewer than n of them, is cut by the hashes of its texts
    share = max(1, total // n)
    many = rows.groupBy("none", "doc_id").agg(F.count("*").alias("c")).filter(F.col("c") > 2 * share)
    many = F.broadcast(staged(many.select("none", F.coalesce("doc_id", F.lit(0)).alias("id"), F.least(F.lit(1 << 20), F.ceil(F.col("c") / share)).alias("cuts"))))
    sub = F.floor((F.lit(0.5) - F.col("h") / float(1 << 64)) * F.coalesce("cuts", F.lit(1)))  # the largest hashes first

    def dealt(df: DataFrame) -> DataFrame:
        df = df.withColumn("id", F.coalesce("doc_id", F.lit(0))).join(many, ["none", "id"], "left")
        return df.withColumn("bucket", bucket + F.least(sub, F.coalesce("cuts", F.lit(1)) - 1)).drop("cuts")

    rows = dealt(rows)
    # the first row of each bucket, in a copy, also goes to the bucket before it, and the very first one to the last
    heads = staged(rows.groupBy("bucket").agg(F.max_by(F.struct("doc_id", "none", "h", "text"), F.struct("none", "id", "h", "text")).alias("head")))
    order = sorted(r.bucket for r in heads.select("bucket").collect())  # a number for each bucket
    own = rows.select("bucket", "doc_id", "none", "h", "text", F.lit(True).alias("own"))
    if groups is not None:
        tags = groups.groupBy(F.col("doc_id"), F.col("text_a").alias("h")).agg(F.min("component_id").alias("component_id"))
        own = own.unionByName(dealt(tags.withColumn("none", F.col("doc_id").isNull())).select("bucket", "doc_id", "none", "h", F.lit("").alias("text"), F.lit(True).alias("own"), F.lit(True).alias("tag"), "component_id"), allowMissingColumns=True)
    if order:
        before = F.create_map(*[F.lit(x) for i, b in enumerate(order) for x in (b, order[i - 1])])[F.col("bucket")]
        own = own.unionByName(heads.select(before.alias("bucket"), "head.*", F.lit(False).alias("own")), allowMissingColumns=True)
    if groups is None:
        own = own.select("*", F.lit(None).cast("boolean").alias("tag"), F.lit(None).cast("long").alias("component_id"))
    own = own.repartition(parts, "bucket").sortWithinPartitions("bucket", F.desc("own"), F.desc("none"), F.desc("doc_id"), F.desc("h"), F.desc("tag"), F.desc("text"))
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double" + (", component_id bigint" if groups is not None else "")
    return own.select("bucket", "doc_id", "text", "own", "tag", "component_id").mapInArrow(_compared_rows(groups is not None), schema)


def op5_spot_signatures(spark, sf_dir: str) -> DataFrame:
    """component_id is the least doc_id of those that links of a likeness of 0.8 or more lead to, itself included."""
    from .spot_groups import groups

    docs = columns(table(spark, sf_dir, "documents"), doc_id="long", text="string")
    return edited(docs, groups(docs))


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, buf, offsets in t.chunks(batch.column("text")):
            sigs = signatures(buf, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array([s.astype(np.int64) for s in sigs], pa.list_(pa.int64()))], names=["doc_id", "sigs"])


def _alike_rows(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            near = np.array([jaccard(x[i].values.to_numpy(), y[i].values.to_numpy(), least) for i in range(len(x))])
            keep = pa.array(near >= least, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.float64())], names=["a", "b", "likeness"]).filter(keep)

    return run


def classes(docs: DataFrame) -> DataFrame:
    """(class, least, n, sigs): each distinct fingerprint of docs(doc_id, text) with its least doc_id and its number of rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(_signature_rows, "doc_id bigint, sigs array<bigint>")
    return staged(rows.groupBy("sigs").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))).select(F.xxhash64("sigs").alias("class"), "least", "n", "sigs")


def similar_pairs(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b, a_class, b_class, likeness) between classes of equal fingerprints of docs(doc_id, text), a and b their least doc_ids, with a likeness of `least` or more.

    Classes are partitioned by set length: each is in the band of its own length
    and in the next, so that those alike enough meet in one of them.  With the
    rarest signatures first, they share one of the first n - ceil(least * n) + 1.
    Pairs meet by their signatures, so the work grows with the square of the
    classes that share a rare one; copies are one class.
    """
    found = classes(docs)
    often = found.select("class", F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("often"))
    ranked = found.select("class", F.size("sigs").alias("size"), F.explode("sigs").alias("sig")).join(often, "sig")
    by = Window.partitionBy("class").orderBy("often", "sig")
    index = ranked.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1)
    band = F.floor(F.log("size") / F.log(F.lit(1 / least)) + 1e-9) if 0 < least < 1 else F.lit(0)
    index = index.select("sig", "class", "size", F.posexplode(F.array(band, band + 1)).alias("up", "band"))
    a, b = index.filter("up = 0").alias("a"), index.alias("b")
    once = (F.col("b.up") == 1) | (F.col("a.class") < F.col("b.class"))
    met = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.band") == F.col("b.band")) & once & (F.least("a.size", "b.size") >= least * F.greatest("a.size", "b.size") - 1e-9))
    pairs = met.select(F.col("a.class").alias("a"), F.col("b.class").alias("b")).distinct()
    sets = found.select("class", "sigs")
    both = pairs.join(sets.withColumnsRenamed({"class": "a", "sigs": "x"}), "a").join(sets.withColumnsRenamed({"class": "b", "sigs": "y"}), "b")
    alike = both.select("a", "b", "x", "y").mapInArrow(_alike_rows(least), "a bigint, b bigint, likeness double")
    names = found.select("class", "least")
    out = alike.join(names.withColumnsRenamed({"class": "a", "least": "x"}), "a").join(names.withColumnsRenamed({"class": "b", "least": "y"}), "b")
    swap = F.col("y") < F.col("x")
    return out.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("b"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a_class"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b_class"), "likeness")
