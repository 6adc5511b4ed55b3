"""Merkle manifest of a table, with nested-interval labels.

Every node covers an interval of leaf ranks [lo, hi) of its group.  Nodes are
kept by levels in blocks: a block holds the HEIGHT levels over `fanout` **
HEIGHT consecutive nodes, so that an ancestor's block is found by an equality of
bucket numbers, and containment of intervals confirms it.  Within a parent's
children, those whose interval is not the one that holds the leaf are its
siblings: the parent's interval less the child's.  Blocks are built from the
leaves up and carry paths from the root down; each storey is one grouping of at
most `fanout` ** HEIGHT rows a key, whatever the size of a group.

Defined results: a null value is written `-`; null ids come first, equal ids in
the order of their leaves' digests; repeated rows are leaves of their own; an
empty or very long text is hashed whole; an empty table has no leaves and no
rows.  Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.functions.ranking import few, positions

from .common import columns, staged, table

FANOUT = 2

#: Levels in a block: a key gathers FANOUT ** HEIGHT nodes.
HEIGHT = 8

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "array<struct<lo:bigint,hi:bigint,digest:string>>"
PATH = "array<struct<l:string,r:string>>"


def digest(*fields: Column) -> Column:
    """SHA-256, lower-case hex, of the fields one after the other: `-` for null, else the number of UTF-8 bytes, `:`, the value."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def _run_at(below: Column, fanout: int):
    return lambda i: F.slice(below, i, fanout)


def _joined(nodes: Column, keep) -> Column:
    return F.array_join(F.transform(F.filter(nodes, keep), lambda c: c["digest"]), "")


def _storey(nodes: DataFrame, fanout: int, height: int, payload: str | None = None) -> DataFrame:
    """Blocks (grp, left, bucket, l0...lH, items) over nodes(grp, left, idx, lo, hi, digest): the levels over each fanout ** height consecutive nodes.

    left is the number of levels that the nodes have below their group's root; levels above it are null.
    """
    width = fanout**height
    item = F.struct("lo", "hi", "digest", *([payload] if payload else []))
    out = nodes.groupBy("grp", "left", F.floor(F.col("idx") / width).alias("bucket")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    out = out.withColumn("l0", F.transform("items", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["digest"].alias("digest"))))
    for j in range(height):
        below = F.col(f"l{j}")
        first = F.sequence(F.lit(1), F.size(below), F.lit(fanout))
        runs = F.transform(first, _run_at(below, fanout))
        parents = F.transform(runs, lambda r: F.struct(r[0]["lo"].alias("lo"), F.element_at(r, -1)["hi"].alias("hi"), F.sha2(F.array_join(F.transform(r, lambda x: x["digest"]), ""), 256).alias("digest")))
        out = out.withColumn(f"l{j + 1}", F.when(F.col("left") > j, parents).otherwise(F.lit(None).cast(NODE)))
    return out


def _steps(x: Column, span: int, fanout: int, height: int) -> Column:
    """For an item x of a block, a struct for each level to the block's top: the digests of its siblings left and right of it, found by their intervals.

    span: leaf ranks that a node of the block's lowest level covers, if whole.
    """
    steps = []
    base = F.col("l0")[0]["lo"]
    for j in range(height):
        parent = F.floor((x["lo"] - base) / (span * fanout ** (j + 1)))
        children = F.slice(F.col(f"l{j}"), (parent * fanout + 1).cast("int"), fanout)
        before, behind = _joined(children, lambda c: c["hi"] <= x["lo"]), _joined(children, lambda c: c["lo"] >= x["hi"])
        steps.append(F.when(F.col(f"l{j + 1}").isNotNull(), F.struct(before.alias("l"), behind.alias("r"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def _with_steps(span: int, fanout: int, height: int):
    return lambda x: F.struct(x.alias("x"), _steps(x, span, fanout, height).alias("own"))


def _powers(fanout: int) -> list[int]:
    out = [1]
    while out[-1] * fanout < 1 << 62:
        out.append(out[-1] * fanout)
    return out


def tree(leaves: DataFrame, fanout: int = FANOUT, height: int = HEIGHT, payload: str | None = None) -> tuple[list[DataFrame], DataFrame]:
    """The storeys of blocks over leaves(grp, n, rank, digest, and if named a payload column), and roots(grp, digest); n is the leaves of the group."""
    left = F.size(F.filter(F.array(*[F.lit(p) for p in _powers(fanout)]), lambda p: p < F.col("n")))
    nodes = leaves.select("grp", left.alias("left"), F.col("rank").alias("idx"), F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", *([payload] if payload else []))
    storeys, roots = [], None
    while True:
        blocks = staged(_storey(nodes, fanout, height, payload if not storeys else None))
        top = blocks.select("grp", "left", "bucket", F.coalesce(*[F.col(f"l{j}") for j in range(height, -1, -1)])[0].alias("x"))
        done = top.filter(F.col("left") <= height).select("grp", "x.digest")
        roots = done if roots is None else roots.unionByName(done)
        storeys.append(blocks)
        more = top.filter(F.col("left") > height)
        if more.isEmpty():
            return storeys, roots
        nodes = more.select("grp", (F.col("left") - height).alias("left"), F.col("bucket").alias("idx"), "x.lo", "x.hi", "x.digest")


def paths(storeys: list[DataFrame], above: DataFrame, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """(grp, x, path) for every leaf: x its item, path its siblings' digests from the leaf up, then those of above(grp, path)."""
    carried = None
    for s in range(len(storeys) - 1, -1, -1):
        blocks = storeys[s].withColumns({"blo": F.col("l0")[0]["lo"], "bhi": F.element_at("l0", -1)["hi"]})
        root = few(above.withColumnsRenamed({"grp": "g", "path": "upper"}))
        whole = blocks.filter(F.col("left") <= height).join(root, F.col("grp") == F.col("g")).drop("g")
        if carried is not None:
            # the block of an ancestor is the one with its bucket's number, and its interval holds this block's
            up = few(staged(carried.select(F.col("grp").alias("g"), F.col("x.lo").alias("plo"), F.col("x.hi").alias("phi"), F.col("idx").alias("pb"), F.col("path").alias("upper"))))
            within = (F.col("grp") == F.col("g")) & (F.col("bucket") == F.col("pb")) & (F.col("plo") <= F.col("blo")) & (F.col("bhi") <= F.col("phi"))
            part = blocks.filter(F.col("left") > height).join(up, within).drop("g", "pb", "plo", "phi")
            whole = whole.unionByName(part)
        span = fanout ** (height * s)
        items = F.transform("items", _with_steps(span, fanout, height))
        out = whole.select("grp", "upper", F.explode(items).alias("i"))
        carried = out.select("grp", F.col("i.x").alias("x"), F.concat("i.own", "upper").alias("path"), F.floor(F.col("i.x.lo") / span).alias("idx"))
    return carried.drop("idx")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings, from the leaf up, give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["l"], acc, s["r"]), 256))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", by: str = "lang", fanout: int = FANOUT, height: int = HEIGHT, other: Column | None = None) -> DataFrame:
    """(key, by, rank, leaf, subroot, root, proof_sha256, path) for every row; docs holds the fields, key and by among them.

    path: the siblings' digests left and right of each ancestor, from the leaf
    up through the group's root to the root.  With `other` (a digest to be
    checked in the place of a row's own, where it is not null), folded_root and
    verified are of that.
    """
    have = other is not None
    rows = staged(docs.select(F.col(key).alias("k"), F.col(by).alias("b"), digest(*[F.col(f) for f in fields]).alias("leaf"), *([other.alias("other")] if have else [])))
    placed = staged(positions(rows, ["b"], ["k", "leaf"], "rank", "n"))
    groups = staged(placed.groupBy("b").agg(F.max("n").alias("n")))
    names = staged(positions(groups, [], ["b"], "grp").select("grp", F.col("b").alias("name"), "n"))
    leaves = placed.drop("n").join(few(names), placed.b.eqNullSafe(names.name)).select("grp", "n", "rank", F.col("leaf").alias("digest"), F.struct("k", *(["other"] if have else [])).alias("own"))
    storeys, subroots = tree(leaves, fanout, height, "own")
    subroots = staged(subroots)
    n = subroots.count()
    top = subroots.select(F.lit(0).cast("long").alias("grp"), F.lit(n).cast("long").alias("n"), F.col("grp").alias("rank"), "digest", F.col("digest").alias("own"))
    upper, roots = tree(top, fanout, height, "own")
    root = roots.select("digest").first()
    above = staged(paths(upper, docs.sparkSession.range(1).select(F.col("id").alias("grp"), F.array().cast(PATH).alias("path")), fanout, height).select(F.col("x.lo").alias("grp"), "path", F.col("x.digest").alias("subroot")))
    out = paths(storeys, above.select("grp", "path"), fanout, height)
    out = out.join(few(above.select(F.col("grp").alias("g"), "subroot").join(names.select(F.col("grp").alias("g"), F.col("name").alias("b")), "g")), F.col("grp") == F.col("g"))
    root = F.lit(root[0] if root else None)
    cols = [F.col("x.own.k").alias(key), "b", F.col("x.lo").alias("rank"), F.col("x.digest").alias("leaf"), "subroot", root.alias("root"), F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), ""), 256).alias("proof_sha256"), "path"]
    out = out.select(*cols, *([F.col("x.own.other").alias("other")] if have else []))
    if not have:
        return out.withColumnRenamed("b", by)
    return out.withColumn("folded_root", fold(F.coalesce("other", "leaf"), F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root")).drop("other").withColumnRenamed("b", by)


def op11_interval_merkle(spark, sf_dir: str) -> DataFrame:
    docs = columns(table(spark, sf_dir, "documents"), doc_id="long", source="string", lang="string", n_chars="long", text="string")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    other = F.when(tampered, digest(*[F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS]))
    return manifest(docs, other=other).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
