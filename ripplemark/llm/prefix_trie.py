"""Prefix trie of conversations: ternary search trees by range shards, merged at the shards' edges.

Turns are dictionary-encoded.  Conversations are dealt by ranges of their turn
ids, equal ones counted as one before; a run of RUN consecutive sequences is a
shard, for which a ternary search tree is built, the median inserted first and
then the medians of both halves, so that it is balanced.  An iterative traversal
from the last node made to the first sums members, leaves and savings up to the
nodes that other shards may hold as well: the prefixes of a shard's first and
last sequence.  Only these are merged across shards, and their sums go to all
their ancestors at once.

Sequences are cut into storeys of STOREY turns, so that a task never holds a
long conversation: a storey's sequences start at a node of the one above, and
a conversation that is alone in such a node goes on as rows, one a turn, which
no tree needs.  Sums go from the deepest storey up.

Defined results: turns come by their number, null first, equal numbers in the
order of their turns' SHA-256; a null role or text is empty; rows without a
conversation's id belong to none and are left out; very long texts are hashed
and measured whole; conversations that are equal make the same nodes; an empty
table has no nodes.  Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.functions.ranking import few, positions

from .common import columns, staged, table

#: Turns of a storey, sequences of a shard, turns that a shard may hold beyond that.
STOREY, RUN, TURNS = 32, 4096, 1 << 18

#: Ids whose numbers agree above so many bits are joined to one text before a node's ids are hashed.
TOGETHER = 12

SEQUENCE = ("top", "top_conv", "ids", "sizes", "n", "conv", "kids", "leaves", "saved")
NODE = "key string, parent string, depth bigint, size bigint, n bigint, conv bigint, pconv bigint, kids bigint, leaves bigint, saved bigint, chain array<string>"
ROOT = hashlib.sha256(b"").hexdigest()[:32]


class Tree:
    """A ternary search tree over sequences below one node; node 0 is that one."""

    def __init__(self):
        self.split, self.low, self.high, self.down = [0], [-1], [-1], [-1]
        self.above, self.size, self.n, self.conv, self.kids, self.leaves, self.saved = [-1], [0], [0], [None], [0], [0], [0]

    def _child(self, at: int, turn: int, size: int) -> int:
        x, new, side = self.down[at], len(self.split), self.down
        where = at
        while x >= 0:
            if turn == self.split[x]:
                return x
            side, where = (self.low, x) if turn < self.split[x] else (self.high, x)
            x = side[where]
        side[where] = new
        for values, v in ((self.split, turn), (self.low, -1), (self.high, -1), (self.down, -1), (self.above, at), (self.size, size), (self.n, 0), (self.conv, None), (self.kids, 0), (self.leaves, 0), (self.saved, 0)):
            values.append(v)
        return new

    def insert(self, row: tuple) -> None:
        """row: as SEQUENCE from `ids` on."""
        ids, sizes, n, conv, kids, leaves, saved = row
        at, path = 0, [0]
        for turn, size in zip(ids, sizes, strict=True):
            at = self._child(at, turn, size)
            path.append(at)
        for x in path:
            self.n[x] += n
            self.conv[x] = conv if self.conv[x] is None else min(conv, self.conv[x])
        self.kids[at] += kids
        self.leaves[at] += leaves
        self.saved[at] += saved

    def path(self, ids: list[int]) -> list[int]:
        at, out = 0, [0]
        for turn in ids:
            at = self._child(at, turn, 0)
            out.append(at)
        return out


def balanced(rows: list[tuple]) -> Tree:
    """The tree over sorted distinct sequences, medians first."""
    tree, ranges = Tree(), [(0, len(rows))]
    while ranges:
        low, high = ranges.pop()
        if low < high:
            mid = (low + high) // 2
            tree.insert(rows[mid])
            ranges += [(mid + 1, high), (low, mid)]
    return tree


def _nodes(run: list[tuple], depth: int) -> Iterator[tuple]:
    """Rows of NODE for a shard of sorted sequences (SEQUENCE); those with a chain may be in other shards too."""
    low = 0
    while low < len(run):
        top, top_conv = run[low][:2]
        high = low
        while high < len(run) and run[high][0] == top:
            high += 1
        tree = balanced([r[2:] for r in run[low:high]])
        if top_conv is not None:
            tree.conv[0] = top_conv
        edge = bytearray(len(tree.split))
        for x in [0, *(tree.path(run[0][2]) if low == 0 else ()), *(tree.path(run[-1][2]) if high == len(run) else ())]:
            edge[x] = 1
        for x in range(len(tree.split) - 1, -1, -1):  # a child comes after its parent
            if not edge[x]:
                up = tree.above[x]
                tree.leaves[x] += not tree.kids[x]
                tree.saved[x] += (tree.n[x] - 1) * tree.size[x]
                tree.kids[up] += 1
                tree.leaves[up] += tree.leaves[x]
                tree.saved[up] += tree.saved[x]
        hashes, keys, deep, chains = [hashlib.sha256(top.encode())], [top or ROOT], [depth], {0: [top or ROOT]}
        for x in range(len(tree.split)):
            up = tree.above[x]
            if x:
                h = hashes[up].copy()
                h.update(b",%d" % tree.split[x])
                hashes.append(h)
                keys.append(h.hexdigest()[:32])
                deep.append(deep[up] + 1)
                if edge[x]:
                    chains[x] = [*chains[up], keys[x]]
            yield (keys[x], keys[up] if x else None, deep[x], tree.size[x], tree.n[x], tree.conv[x], tree.conv[up] if x and not edge[up] else None, tree.kids[x], tree.leaves[x], tree.saved[x], chains.get(x))
        low = high


def _tries(depth: int, run_rows: int, run_turns: int):
    schema = pa.schema([(c, pa.string() if c in ("key", "parent") else pa.list_(pa.string()) if c == "chain" else pa.int64()) for c in (f.split()[0] for f in NODE.split(", "))])

    def batch(run: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = list(_nodes(run, depth))
        for low in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[low : low + 10_000], strict=True), schema, strict=True)], schema=schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sequences sorted by (top, ids), in runs."""
        run, turns = [], 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in SEQUENCE), strict=True):
                run.append(row)
                turns += len(row[2])
                if len(run) >= run_rows or turns >= run_turns:
                    yield from batch(run)
                    run, turns = [], 0
        if run:
            yield from batch(run)

    return build


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ids) sorted by key and then by the ids' block: the SHA-256 of all of a key's ids, read one block after the other."""
    key, h = None, None
    for b in batches:
        done = []
        for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if k == key:
                h.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((key, h.hexdigest()))
            key, h = k, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in range(2)], names=["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], names=["key", "ends_sha256"])


def _partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def encoded(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, id, size, n): each turn's place from 1 on, the number of its (role, text) in a dictionary of all, its text's bytes, and the conversation's turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    code = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = staged(conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", code.alias("code"), F.octet_length(text).cast("long").alias("size")))
    words = staged(rows.select("code").distinct().withColumn("id", F.monotonically_increasing_id()))
    placed = positions(rows, ["conv_id"], ["turn", "code"], "pos", "n")
    return staged(placed.join(words, "code").select("conv_id", (F.col("pos") + 1).alias("pos"), "id", "size", "n"))


def _key(top: str, ids: str) -> Column:
    return F.substring(F.sha2(F.concat_ws(",", F.col(top), F.col(ids).cast("array<string>")), 256), 1, 32)


def _sequences(rows: DataFrame, active: DataFrame, t: int, storey: int) -> DataFrame:
    """(conv_id, len, top, top_conv, ids, sizes, key): the turns of storey t of every active conversation."""
    part = rows.filter((F.col("pos") > t * storey) & (F.col("pos") <= (t + 1) * storey))
    if t:
        part = part.join(active.select("conv_id"), "conv_id", "left_semi")
    part = part.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "size"))).alias("c")).select(F.col("conv_id").alias("_c"), F.col("c.id").alias("_ids"), F.col("c.size").alias("_sizes"))
    none = F.array().cast("array<bigint>")
    both = active.join(part, F.col("conv_id") == F.col("_c"), "left").select(*active.columns, F.coalesce("_ids", none).alias("ids"), F.coalesce("_sizes", none).alias("sizes"))
    return staged(both.withColumn("key", _key("top", "ids")))


def _merged(edges: DataFrame) -> DataFrame:
    """Nodes that several shards may hold, with their sums over the shards and over the merged nodes below them."""
    one = edges.groupBy("key", "parent", "depth", "size", "chain").agg(F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    one = staged(one)
    kids = one.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("more"))
    one = staged(one.join(kids, "key", "left").withColumn("kids", F.col("kids") + F.coalesce("more", F.lit(0))).drop("more"))
    own = one.select(F.explode("chain").alias("key"), (F.col("leaves") + (F.col("kids") == 0).cast("long")).alias("l"), (F.col("saved") + (F.col("n") - 1) * F.col("size")).alias("s"))
    sums = own.groupBy("key").agg(F.sum("l").alias("leaves"), F.sum("s").alias("saved"))
    return staged(one.drop("leaves", "saved", "chain").join(sums, "key"))


def trie(rows: DataFrame, convs: DataFrame, storey: int = STOREY, run: int = RUN) -> DataFrame:
    """(key, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for every distinct prefix.

    rows(conv_id, pos, id, size): turns, pos from 1 on without gaps; convs(conv_id, len): every conversation, turnless ones too.
    """
    parts = _partitions(rows)
    active = convs.select("conv_id", "len", F.lit("").alias("top"), F.lit(None).cast("long").alias("top_conv"))
    storeys, ends, tails, t = [], None, [], 0
    while True:
        own = _sequences(rows, active, t, storey)
        seqs = staged(own.groupBy("top", "top_conv", "key", "ids", "sizes").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv")))
        storeys.append(seqs)
        over = own.filter(F.col("len") <= (t + 1) * storey).select("key", "conv_id")
        ends = over if ends is None else ends.unionByName(over)
        going = own.filter(F.col("len") > (t + 1) * storey).select("conv_id", "len", F.col("key").alias("top"))
        going = staged(going.join(seqs.select(F.col("key").alias("top"), "n", F.col("conv").alias("top_conv")), "top"))
        tails.append(going.filter("n = 1"))
        active = going.filter("n > 1").select("conv_id", "len", "top", "top_conv")
        if active.isEmpty():
            break
        t += 1
    out, below = None, None
    for t in range(len(storeys) - 1, -1, -1):
        alone = tails[t].select("top", F.lit(1).cast("long").alias("kids"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        below = (alone if below is None else alone.unionByName(below)).withColumnRenamed("top", "_top")
        seqs = storeys[t].join(below, F.col("key") == F.col("_top"), "left").na.fill(0, ["kids", "leaves", "saved"])
        dealt = staged(seqs.select(*SEQUENCE)).repartitionByRange(parts, "top", "ids").sortWithinPartitions("top", "ids")
        made = staged(dealt.mapInArrow(_tries(t * storey, run, TURNS), NODE))
        edges = _merged(made.filter("chain IS NOT NULL").drop("pconv"))
        parent = few(edges.select(F.col("key").alias("_key"), F.col("conv").alias("_conv")))
        names = ["key", "depth", "conv", "pconv", "n", "kids", "leaves", "saved"]
        inner = made.filter("chain IS NULL")
        inner = inner.filter("pconv IS NOT NULL").select(names).unionByName(inner.filter("pconv IS NULL").join(parent, F.col("parent") == F.col("_key")).withColumn("pconv", F.col("_conv")).select(names))
        outer = edges.join(parent, F.col("parent") == F.col("_key"), "left").withColumn("pconv", F.col("_conv")).select(names)
        nodes = inner.unionByName(outer.filter(F.col("depth") > t * storey) if t else outer)
        out = nodes if out is None else out.unionByName(nodes)
        below = edges.filter(F.col("depth") == t * storey).select(F.col("key").alias("top"), "kids", "leaves", "saved")
    block = ends.groupBy("key", F.shiftright("conv_id", TOGETHER).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    digests = block.repartition(parts, "key").sortWithinPartitions("key", "block").select("key", "ids").mapInArrow(_hashed, "key string, ends_sha256 string")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = out.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    for t, tail in enumerate(tails):
        own = tail.select(F.col("conv_id").alias("_c"), "len").join(rows.filter(F.col("pos") > (t + 1) * storey), F.col("_c") == F.col("conv_id"))
        last = F.col("pos") == F.col("len")
        one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
        out = out.unionByName(own.select(F.sha2(F.concat_ws(" ", "conv_id", "pos"), 256).alias("key"), F.col("pos").alias("depth"), F.col("conv_id").alias("conv"), F.col("conv_id").alias("pconv"), one.alias("n"), F.when(last, zero).otherwise(one).alias("kids"), one.alias("leaves"), zero.alias("saved"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none).alias("ends_sha256")))
    return out.select("key", "depth", F.col("conv").alias("conv_id"), F.col("pconv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")


def rebuilt(turns: DataFrame, head: Column, base: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first `head` turns of conversation `base` and go on with their own turns behind their first `head`: rows and convs as trie() reads them.

    turns: of encoded(); head (at most `most`) and base: columns over conv_id.
    """
    whole = turns.filter("pos = 1").select("conv_id", "n", head.alias("h"), base.alias("base"))
    other = whole.select(F.col("conv_id").alias("_b"), F.col("n").alias("_n"))
    convs = whole.join(other, F.col("base") == F.col("_b"), "left").withColumn("m", F.least("h", F.coalesce("_n", F.lit(0))).cast("long"))
    convs = staged(convs.select("conv_id", "h", "base", "m", (F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("len")))
    first = turns.filter(F.col("pos") <= most).select(F.col("conv_id").alias("_b"), "pos", "id", "size")
    first = first.join(convs.select("conv_id", "base", "m"), (F.col("base") == F.col("_b")) & (F.col("pos") <= F.col("m"))).select("conv_id", "pos", "id", "size")
    rest = turns.select(F.col("conv_id").alias("_c"), "pos", "id", "size").join(convs.select("conv_id", "h", "m"), (F.col("conv_id") == F.col("_c")) & (F.col("pos") > F.col("h")))
    return staged(first.unionByName(rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "id", "size"))), convs.select("conv_id", "len")


def op12_ternary_trie(spark, sf_dir: str) -> DataFrame:
    rows = columns(table(spark, sf_dir, "conversations"), conv_id="long", turn="long", role="string", text="string")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    out = trie(*rebuilt(encoded(rows), head, F.col("conv_id") - F.col("conv_id") % 5, 8))
    return out.drop("key")
