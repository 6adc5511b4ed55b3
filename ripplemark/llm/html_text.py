"""HTML main text by wrapper induction.

A page is read into a tree of its structural elements, in which equal siblings
are one node.  The trees of a host's pages are merged, by simple tree matching,
into the host's tree, and every page's tree is aligned to that one.  Over the
host's different pages it is counted at how many of those that have a node a
block of text stands there: one that (nearly) all have is template, and the
others fill a slot.  From the root down, the region that holds the main part of
the text in slots is the host's content: a page's main text are the blocks in the
slots of that region, and first headings.

Menus, adverts and comments can vary from page to page, too.  So no slot counts
where an element's tag or class names a menu, header, footer, sidebar, notice,
advert, form or reader comments.  Article and main elements or classes decide
only on hosts with fewer than PAGES different pages, and on pages that have
nothing in their host's region.

A host's statistics are sums over (host, node, block) rows, and trees are merged
FANIN at a time, so that no task holds the pages of a host.  The merged tree has a
node for each path of labels that the host's pages use.

Defined results: null and empty pages give an empty text; a url without a host
is a host of its own; equal page_ids are separate rows, and equal pages count
once for the template; very long, deep or broken pages take time in proportion
to their length; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, small, staged, table

#: A host of so many different pages has a wrapper; a block that so many of those with a node have there, and this share of them, is template.
PAGES, REPEATED, SHARE = 2, 10, 0.9
MAIN_PART = 0.5  # of the text in slots, what the content region holds at least
FANIN = 64  # trees that a task merges at a time
CACHED = 20_000  # characters of a tree up to which its alignment is remembered

# Kinds of elements, and words of classes and ids that mark what is no main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
CLOSED_BY_BLOCK = frozenset(("p",))
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NOT_MAIN_TAGS = frozenset("nav footer aside form header menu dialog head".split())
NOT_MAIN_WORDS = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar side footer header masthead "
    "cookie cookies consent notice notices alert popup modal newsletter subscribe signup login comment comments disqus replies reply share sharing social related recommended "
    "pagination pager toolbar widget copyright legal".split()
)
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article main maintext content entry post story".split())

# The parts of these patterns never give back what they matched, so that they read a tag once.  Without quotes: for pages with quotes that do not close.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_TAG_WITHOUT_QUOTES = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("label", "tag", "kind", "parent", "children", "blocks", "main", "off")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        tokens = [w for m in _NAMES.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()] if attributes else []
        names = [w for x in tokens for w in _WORD.findall(x)]
        self.tag, self.parent, self.children, self.blocks = tag, parent, {}, []
        self.label = ".".join((tag, *sorted(set(names))))
        self.off = tag in NOT_MAIN_TAGS or (tag not in ("html", "body") and any(w in NOT_MAIN_WORDS for w in (tokens if tag in MAIN_TAGS else names)))
        self.main = tag in MAIN_TAGS or any(w in MAIN_WORDS for w in names)


def _judge(nodes: list[Node], blocks: list[tuple[int, str]]) -> None:
    """Hands down what single nodes say; a form around an article, or an element around it with most of the page's text, switches nothing off."""
    place = {id(v): i for i, v in enumerate(nodes)}
    size, holds = [0] * len(nodes), [False] * len(nodes)
    for i, text in blocks:
        size[i] += len(text)
    for i in range(len(nodes) - 1, 0, -1):
        up = place[id(nodes[i].parent)]
        size[up] += size[i]
        holds[up] |= holds[i] or nodes[i].tag in MAIN_TAGS
    for v, n, around in zip(nodes, size, holds, strict=True):
        if around and (v.tag == "form" or 2 * n > size[0]):
            v.off = False
        v.off = v.off or (v.parent is not None and v.parent.off)
        v.main = not v.off and (v.main or (v.parent is not None and v.parent.main))


class Page(NamedTuple):
    """nodes: in document order of their first appearance, parents first; blocks: (node's index, text) in page order."""

    nodes: list[Node]
    blocks: list[tuple[int, str]]


@lru_cache(64)
def _closer(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


class Tokens:
    """The text and the tags of a page, in order: (text, None) and ("", match)."""

    def __init__(self, text: str):
        self.text, self.at, self.end, self.last, self.tag = text, 0, len(text), text.rfind(">"), _TAG
        self.open_ended: set[str] = set()

    def __iter__(self) -> Iterator[tuple[str, re.Match | None]]:
        text, begin = self.text, 0
        while True:
            p = text.find("<", max(begin, self.at))
            if p < 0:
                yield text[self.at :], None
                return
            begin = p + 1
            if p > self.last:  # no tag ends any more; one that begins is cut off with the page
                if text.startswith(("!", "?"), begin) or re.match(r"/?[A-Za-z]", text[begin : begin + 2]):
                    yield text[self.at : p], None
                    return
                continue
            if text.startswith(("<!", "<?"), p):
                opens, closes = next(x for x in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")) if text.startswith(x[0], p))
                yield text[self.at : p], None
                stop = text.find(closes, p + len(opens))
                self.at = stop + len(closes) if stop >= 0 else self.end
                continue
            name = text[begin : begin + 2].lstrip("/")[:1]
            if not (name.isascii() and name.isalpha()):
                continue
            m = self.tag.match(text, p)
            if m is None and self.tag is _TAG:
                self.tag = _TAG_WITHOUT_QUOTES
                m = self.tag.match(text, p)
            if m is not None:
                yield text[self.at : p], None
                self.at = m.end()
                yield "", m

    def skip(self, tag: str) -> None:
        """Go behind the end of an element whose content is not read; where it has none, only scripts and styles reach to the end of the page."""
        found = None if tag in self.open_ended else _closer(tag).search(self.text, self.at)
        if found:
            self.at = found.end()
            return
        self.open_ended.add(tag)
        if tag in ("script", "style"):
            self.at = self.end


def parse(text: str | None) -> Page:
    """The structural tree of a page; siblings of one label are one node."""
    root = Node("", "", None)
    nodes, index, blocks = [root], {id(root): 0}, []
    stack: list[tuple[str, Node]] = []
    opened: Counter[str] = Counter()
    here, parts, tokens = root, [], Tokens(text or "")

    def flush() -> None:
        if parts:
            words = html.unescape("".join(parts)).split()
            parts.clear()
            if words:
                blocks.append((index[id(here)], " ".join(words)))

    for between, m in tokens:
        if m is None:
            parts.append(between)
            continue
        tag = m[2].lower()
        if tag in RAW and not m[1]:
            if not m[3].endswith("/"):
                tokens.skip(tag)
            parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            continue
        flush()
        if tag in VOID or tag in RAW:
            continue
        if m[1]:
            while opened[tag]:
                name, node = stack.pop()
                opened[name] -= 1
                here = node.parent
                if name == tag:
                    break
            continue
        closes = (*SELF_CLOSING.get(tag, ()), "p")
        while stack and stack[-1][0] in closes:
            name, node = stack.pop()
            opened[name] -= 1
            here = node.parent
        node = Node(tag, m[3], here)
        known = here.children.get(node.label)
        if known is None:
            here.children[node.label] = known = node
            index[id(node)] = len(nodes)
            nodes.append(node)
        if not m[3].endswith("/"):
            here = known
            stack.append((tag, known))
            opened[tag] += 1
    flush()
    _judge(nodes, blocks)
    return Page(nodes, blocks)


def skeleton(page: Page) -> tuple[str, list[int]]:
    """The tree in preorder as "depth label" lines, and the page's node index of each line."""
    lines, order = [], []
    place = {id(v): i for i, v in enumerate(page.nodes)}
    todo = [(page.nodes[0], 0)]
    while todo:
        node, depth = todo.pop()
        lines.append(f"{depth} {node.label}")
        order.append(place[id(node)])
        todo += [(c, depth + 1) for c in reversed(node.children.values())]
    return "\n".join(lines), order


def _tree(lines: str) -> tuple[list[str], list[list[int]]]:
    labels, children, path = [], [], []
    for i, line in enumerate(lines.split("\n")):
        depth, _, label = line.partition(" ")
        labels.append(label)
        children.append([])
        del path[int(depth) :]
        if path:
            children[path[-1]].append(i)
        path.append(i)
    return labels, children


def _chain(pairs: list[tuple[int, int, int]]) -> list[int]:
    """Of pairs (i, j, weight), sorted by i and falling j, those (by their numbers) of a chain rising in both with the most weight."""
    if len(pairs) < 2:
        return list(range(len(pairs)))
    js = sorted({j for _, j, _ in pairs})
    tree: list[tuple[int, int]] = [(0, -1)] * (len(js) + 1)  # a Fenwick tree of (weight, last pair)
    before = []
    for n, (_, j, w) in enumerate(pairs):
        at, best = bisect_left(js, j), (0, -1)
        k = at
        while k > 0:
            best = max(best, tree[k])
            k -= k & -k
        before.append(best[1])
        k, now = at + 1, (best[0] + w, n)
        while k < len(tree):
            tree[k] = max(tree[k], now)
            k += k & -k
    k, best = len(js), (0, -1)
    while k > 0:
        best = max(best, tree[k])
        k -= k & -k
    out, n = [], best[1]
    while n >= 0:
        out.append(n)
        n = before[n]
    return out[::-1]


def _matched(lines: str, reference: str) -> tuple[int, ...]:
    """Simple tree matching: the order-preserving matching of equal labels, from the roots down, with the most nodes; only pairs of equal labels are looked at."""
    (la, ca), (lb, cb) = _tree(lines), _tree(reference)
    out = [-1] * len(la)
    if la[0] != lb[0]:
        return tuple(out)
    pairs, below, n = [(0, 0)], [], 0
    while n < len(pairs):  # parents before children
        a, b = pairs[n]
        by: dict[str, list[int]] = {}
        for j, y in enumerate(cb[b]):
            by.setdefault(lb[y], []).append(j)
        own = [(i, j) for i, x in enumerate(ca[a]) for j in reversed(by.get(la[x], ()))]
        below.append((len(pairs), own))
        pairs += [(ca[a][i], cb[b][j]) for i, j in own]
        n += 1
    weight, chosen = [1] * len(pairs), [[]] * len(pairs)
    for n in range(len(pairs) - 1, -1, -1):
        first, own = below[n]
        kept = _chain([(i, j, weight[first + k]) for k, (i, j) in enumerate(own)])
        weight[n], chosen[n] = 1 + sum(weight[first + k] for k in kept), [first + k for k in kept]
    todo = [0]
    while todo:
        n = todo.pop()
        out[pairs[n][0]] = pairs[n][1]
        todo += chosen[n]
    return tuple(out)


_remembered = lru_cache(4096)(_matched)


def align(lines: str, reference: str) -> tuple[int, ...]:
    """For each line of a skeleton the reference's line that it matches, or -1."""
    return (_remembered if len(lines) + len(reference) <= CACHED else _matched)(lines, reference)


def merge(reference: str, lines: str) -> str:
    """The reference with the nodes of another skeleton that it lacks, behind their neighbours there."""
    (labels, children), (more, below), found = _tree(reference), _tree(lines), list(align(lines, reference))
    for a, own in enumerate(below):  # parents come first
        to = children[found[a]] if found[a] >= 0 else None
        if to is None:
            continue
        place = {y: i for i, y in enumerate(to)}
        out, at = [], 0
        for x in own:
            if found[x] >= 0:
                out += to[at : place[found[x]] + 1]
                at = place[found[x]] + 1
            else:
                found[x] = len(labels)
                labels.append(more[x])
                children.append([])
                out.append(found[x])
        children[found[a]] = out + to[at:]
    out, todo = [], [(0, 0)]
    while todo:
        n, depth = todo.pop()
        out.append(f"{depth} {labels[n]}")
        todo += [(c, depth + 1) for c in reversed(children[n])]
    return "\n".join(out)


def _hash(block: str) -> int:
    return xxhash.xxh64_intdigest(block) >> 1


def _page_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, shape, content, blocks): a page's skeleton, a hash of all it says, and its blocks by line with their sizes; one without a hash stands for the line itself."""
    kind = pa.list_(pa.struct([("line", pa.int32()), ("hash", pa.int64()), ("size", pa.int64())]))
    for batch in batches:
        shapes, contents, blocks = [], [], []
        for v in batch.column("html"):
            page = parse(v.as_py())
            lines, order = skeleton(page)
            place = {node: line for line, node in enumerate(order)}
            own: dict[tuple, int] = {}
            for i, x in page.blocks:
                for key in ((place[i], _hash(x)), (place[i], None)):
                    own[key] = own.get(key, 0) + (0 if page.nodes[i].off else len(x))
            shapes.append(lines)
            contents.append(_hash(f"{lines}\n{[(i, _hash(x)) for i, x in page.blocks]}"))
            blocks.append([{"line": i, "hash": h, "size": n} for (i, h), n in own.items()])
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(shapes, pa.string()), pa.array(contents, pa.int64()), pa.array(blocks, kind)], names=["host", "shape", "content", "blocks"])


def _merged_block(shapes: pa.Table) -> pa.Table:
    """The trees (host, shape, n) of a block as one; the most frequent first."""
    rows = sorted(zip(shapes.column("n").to_pylist(), shapes.column("shape").to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
    tree = rows[0][1]
    for _, lines in rows[1:]:
        tree = merge(tree, lines)
    return pa.table({"host": shapes.column("host").slice(0, 1), "shape": pa.array([tree], pa.string()), "n": pa.array([sum(n for n, _ in rows)], pa.int64())})


def host_trees(shapes: DataFrame, fanin: int = FANIN) -> DataFrame:
    """(host, tree, pages): the merged skeletons of each host of shapes(host, shape, n), by a tree of merges of about `fanin` at a time."""
    level, most = shapes, fanin + 1
    while most > fanin:
        sizes = level.groupBy("host").agg(F.count("*").alias("size"))
        most = sizes.agg(F.max("size")).first()[0] or 0
        dealt = level.join(sizes, "host").select("host", "shape", "n", F.pmod(F.xxhash64("shape"), F.ceil(F.col("size") / fanin)).alias("block"))
        level = staged(dealt.groupBy("host", "block").applyInArrow(_merged_block, "host string, shape string, n bigint"))
    return level.select("host", F.col("shape").alias("tree"), F.col("n").alias("pages"))


def _aligned_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = [align(shape, tree) for shape, tree in zip(batch.column("shape").to_pylist(), batch.column("tree").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("shape"), pa.array(nodes, pa.list_(pa.int32()))], names=["host", "shape", "nodes"])


def region(tree: str, sizes: dict[int, int], part: float = MAIN_PART) -> tuple[int, int] | None:
    """The lines (from, past the last) of the deepest element around others that has `part` of all text in slots; sizes: that of each line."""
    labels, children = _tree(tree)
    total = [sizes.get(i, 0) for i in range(len(labels))]
    last = list(range(1, len(labels) + 1))
    for i in range(len(labels) - 1, -1, -1):
        for c in children[i]:
            total[i] += total[c]
            last[i] = max(last[i], last[c])
    if total[0] <= 0:
        return None
    at = 0
    while True:
        around = [c for c in children[at] if total[c] >= part * total[0] and any(total[x] > 0 for x in children[c])]
        if not around:
            return at, last[at]
        at = max(around, key=lambda c: total[c])


class Wrapper(NamedTuple):
    """A host's tree, the constant blocks (line, hash) at its nodes, and the lines of its content."""

    tree: str
    constant: frozenset[tuple[int, int]]
    content: tuple[int, int]


def main_text(text: str | None, wrapper: Wrapper | None = None) -> str:
    """The main blocks of a page, by its host's wrapper or, without one, by its marks."""
    page = parse(text)
    if wrapper:
        lines, order = skeleton(page)
        at = dict(zip(order, align(lines, wrapper.tree), strict=True))
        place, number, (low, high) = [], {id(v): i for i, v in enumerate(page.nodes)}, wrapper.content
        for i, v in enumerate(page.nodes):  # parents first: a node that the tree lacks is where its parent is
            place.append(at[i] if at[i] >= 0 or v.parent is None else place[number[id(v.parent)]])
        kept = [b for i, b in page.blocks if not page.nodes[i].off and (low <= place[i] < high or page.nodes[i].tag == "h1") and (at[i], _hash(b)) not in wrapper.constant]
        if kept:
            return "\n\n".join(kept)
    marked = any(page.nodes[i].main for i, _ in page.blocks)
    return "\n\n".join(b for i, b in page.blocks if (page.nodes[i].main if marked else not page.nodes[i].off))


def _wrapper_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        content = [region(tree, {x["node"]: x["size"] for x in sizes or ()}) for tree, sizes in zip(batch.column("tree").to_pylist(), batch.column("sizes").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "tree", "constant")), pa.array(content, pa.list_(pa.int32()))], names=["host", "tree", "constant", "content"])


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, known = [], {}  # the wrappers of the batch's hosts
        for v, host, tree, constant, content in zip(batch.column("html"), batch.column("host").to_pylist(), batch.column("tree"), batch.column("constant"), batch.column("content"), strict=True):
            if host not in known:
                lines = content.as_py()
                known[host] = lines and Wrapper(tree.as_py(), frozenset((c["node"], c["hash"]) for c in constant.as_py() or ()), tuple(lines))
            out.append(main_text(v.as_py(), known[host]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def wrappers(rows: DataFrame, least: int = PAGES, share: float = SHARE, repeated: int = REPEATED) -> DataFrame:
    """(host, tree, constant, content): the wrapper of each host of rows(host, html) with `least` different pages."""
    seen = staged(rows.select("host", "html").mapInArrow(_page_rows, "host string, shape string, content bigint, blocks array<struct<line:int,hash:bigint,size:bigint>>"))
    once = staged(seen.dropDuplicates(["host", "content"]).drop("content"))
    shapes = staged(once.groupBy("host", "shape").agg(F.count("*").alias("n")))
    trees = host_trees(shapes)
    aligned = staged(shapes.join(trees, "host").select("host", "shape", "tree").mapInArrow(_aligned_rows, "host string, shape string, nodes array<int>"))
    nodes = once.join(aligned, ["host", "shape"]).select("host", "nodes", F.explode("blocks").alias("b")).select("host", F.element_at("nodes", F.col("b.line") + 1).alias("node"), "b.hash", "b.size")
    counted = staged(nodes.filter("node >= 0").groupBy("host", "node", "hash").agg(F.count("*").alias("n"), F.sum("size").alias("size")).filter((F.col("n") >= repeated) | F.col("hash").isNull()))
    pages = counted.filter("hash IS NULL").select("host", "node", F.col("n").alias("pages"))
    fixed = counted.filter("hash IS NOT NULL").join(pages, ["host", "node"]).filter(F.col("n") >= share * F.col("pages")).select("host", "node", "hash", "size")
    slots = counted.filter("hash IS NULL").select("host", "node", "size").unionByName(fixed.select("host", "node", (-F.col("size")).alias("size"))).groupBy("host", "node").agg(F.sum("size").alias("size"))
    sizes = slots.groupBy("host").agg(F.collect_list(F.struct("node", "size")).alias("sizes"))
    constant = fixed.groupBy("host").agg(F.collect_list(F.struct("node", "hash")).alias("constant"))
    found = trees.filter(F.col("pages") >= least).join(sizes, "host", "left").join(constant, "host", "left")
    return staged(found.mapInArrow(_wrapper_rows, "host string, tree string, constant array<struct<node:int,hash:bigint>>, content array<int>"))


def extract(pages: DataFrame, least: int = PAGES, share: float = SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html)."""
    host = F.coalesce(F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host)
    return rows.join(small(wrappers(rows, least, share)), "host", "left").mapInArrow(_text_rows, "page_id bigint, url string, text string, n_chars bigint")


def op6_wrapper_html(spark, sf_dir: str) -> DataFrame:
    return extract(columns(table(spark, sf_dir, "pages"), page_id="long", url="string", html="string"))
