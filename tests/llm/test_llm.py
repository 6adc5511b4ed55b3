"""The corpus operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ripplemark.llm import automaton, byte_dedup, decontamination, html_text, licenses, mixing, quality, repeats, simhash, spotsigs, substring, suffix_array, toxicity
from ripplemark.llm import text as t
from ripplemark.llm.components import components

DOCS = "doc_id bigint, text string"
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randint(0, words)}" for _ in range(n))


def corpus(seed: int = 5) -> list[tuple]:
    """Rows with shared passages, exact and near copies, nulls, empties, repeats and a long text."""
    rng = random.Random(seed)
    shared = [prose(rng, 70) for _ in range(3)]
    docs = [(i, prose(rng, rng.randint(5, 160))) for i in range(40)]
    docs += [(40 + i, f"{prose(rng, 20)} {rng.choice(shared)} {prose(rng, 20)}") for i in range(20)]
    docs += [(60 + i, docs[i][1]) for i in range(8)]
    near = prose(rng, 300).split()
    for i in range(8):
        w = list(near)
        w[rng.randrange(300)] = "edit"
        docs.append((70 + i, " ".join(w)))
    docs += [(80, None), (81, ""), (82, " \t\n"), (83, "one"), (84, "la la " * 200), (85, "é ü " + shared[0] + " x"), (86, prose(rng, 30_000)), (None, shared[1])]
    docs += [docs[3], docs[3], (5, prose(rng, 60) + " " + shared[2])]
    return docs


def wide_anchor_rows(hot: int):
    plain = repeats._anchor_rows

    def make(unit, often):
        def run(batches):
            repeats.HOT = hot
            yield from plain(unit, often)(batches)

        return run

    return make


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def test_suffix_array_sorts():
    rng = random.Random(1)
    for _ in range(400):
        s = [rng.randint(0, rng.randint(0, 3)) for _ in range(rng.randint(0, 30))]
        assert suffix_array.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_array_of_repetitions():
    for s in ([1] * 50, [0, 1] * 25, [2, 1, 0] * 15, [1, 0, 1, 1, 0] * 9):
        assert suffix_array.suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_automaton_finds_earlier_windows():
    rng = random.Random(2)
    for _ in range(200):
        seqs = [[rng.randint(0, 2) for _ in range(rng.randint(0, 25))] for _ in range(4)]
        a, seen = automaton.SuffixAutomaton(), set()
        for d, s in enumerate(seqs):
            want = [i + 4 for i in range(len(s) - 3) if tuple(s[i : i + 4]) in seen]
            assert a.earlier(s, 4, d) == want
            a.add(s, d)
            seen |= {tuple(s[i : i + 4]) for i in range(len(s) - 3)}


def test_winnowing_keeps_every_window():
    rng = np.random.default_rng(0)
    grams = rng.integers(0, 5, 300).astype(np.uint64) << np.uint64(40)
    starts, at = t.winnow(grams, np.arange(300, 0, -1), 9)
    for s, p in zip(starts.tolist(), at.tolist(), strict=True):
        w = grams[s : s + 9]
        assert p == s + max(i for i in range(9) if w[i] == w.min())


def count_frequent(monkeypatch, share: int):
    """Anchors of over 1 / (4 * share) of the rows count as frequent, which in so small a table none does by itself."""
    monkeypatch.setattr(repeats, "SHARE", 1)
    monkeypatch.setattr(repeats, "MANY", 1)
    monkeypatch.setattr(repeats, "PER_TASK", share)


@pytest.mark.parametrize(("cap", "hot", "often"), [(None, 16, 0), (200, 16, 0), (None, 1, 0), (200, 0, 0), (None, 16, 10**9), (None, 1, 100)])
def test_substring_dedup(spark, cap, hot, often, monkeypatch):
    if often:
        count_frequent(monkeypatch, often)
    if hot < 16:  # the limit has to reach the workers, which import the module anew
        monkeypatch.setattr(repeats, "_anchor_rows", wide_anchor_rows(hot))
    if cap:  # every group counts as too large for a task
        monkeypatch.setattr(substring.repeats, "__defaults__", (cap,))
    rows = corpus()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen: dict[tuple, int] = {}
    for d, x in order:
        w = (x or "").encode().split()
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), 10**9 if d is None else d)
    want = []
    for d, x in rows:
        w = (x or "").encode().split()
        gone = set()
        for i in range(len(w) - 49):
            if seen[tuple(w[i : i + 50])] < (10**9 if d is None else d):
                gone |= set(range(i, i + 50))
        kept = [v for i, v in enumerate(w) if i not in gone]
        want.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize(("cap", "hot", "often"), [(None, 16, 0), (200, 16, 0), (None, 1, 0), (200, 0, 0), (None, 16, 10**9), (None, 1, 100)])
def test_byte_dedup(spark, cap, hot, often, monkeypatch):
    if often:
        count_frequent(monkeypatch, often)
    if hot < 16:
        monkeypatch.setattr(repeats, "_anchor_rows", wide_anchor_rows(hot))
    if cap:
        monkeypatch.setattr(byte_dedup.repeats, "__defaults__", (cap,))
    rows = corpus(6)
    key = lambda d: 10**9 if d is None else d
    first: dict[bytes, int] = {}
    for d, x in rows:
        b = (x or "").encode()
        for i in range(len(b) - 99):
            first[b[i : i + 100]] = min(key(d), first.get(b[i : i + 100], 10**10))
    want = []
    for d, x in rows:
        b, gone, own = (x or "").encode(), set(), set()
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if first[w] < key(d) or w in own:
                gone |= set(range(i, i + 100))
            own.add(w)
        pieces = sum(1 for i in gone if i - 1 not in gone)
        want.append((d, len(b), len(gone), pieces, hashlib.sha256(bytes(v for i, v in enumerate(b) if i not in gone)).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in byte_dedup.dedup(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_passage_of_every_piece_goes_to_many_tasks(spark, monkeypatch):
    rng, passage = random.Random(31), prose(random.Random(30), 120)
    rows = [(i, f"{prose(rng, 60)} {passage} {prose(rng, 60)}") for i in range(300)]
    docs = frame(spark, rows).repartition(150).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    count_frequent(monkeypatch, 10)
    often = repeats.frequent(docs, substring.UNIT, 4)
    assert 0 < len(often) < 40
    none = np.zeros(0, np.int64)
    largest = [
        docs.mapInArrow(repeats._anchor_rows(substring.UNIT, x), "key bigint, anchor bigint, kind int, context bigint, doc_id bigint, rid bigint").groupBy("key").count().agg(F.max("count")).first()[0]
        for x in (none, often)
    ]
    assert largest[0] >= 150
    assert largest[1] < 20


def test_byte_match_without_ends():
    """Long runs without a space, bytes of other scripts, and zero bytes."""
    rng = random.Random(3)
    for letters in (b"ab ", b"xyzw", "中é a".encode(), b"\x00ab"):
        base = bytes(rng.choice(letters) for _ in range(300))
        spans = sorted((d, 0, base[rng.randint(0, 150) :] + bytes(rng.choice(letters) for _ in range(9))) for d in range(5))
        occ: dict[bytes, list] = {}
        for d, at, c in spans:
            for i in range(len(c) - 59):
                occ.setdefault(c[i : i + 60], []).append((d, at + i))
        want: dict[int, set] = {}
        for o in occ.values():
            for d, i in o:
                if (d, i) != min(o):
                    want.setdefault(d, set()).update(range(i, i + 60))
        got: dict[int, set] = {}
        for d, a, b in byte_dedup.match(spans, 60):
            got.setdefault(d, set()).update(range(a, b))
        assert got == want


def test_decontamination(spark):
    rng = random.Random(7)
    items = [(str(i), prose(rng, n)) for i, n in enumerate((30, 9, 3, 1, 12))] + [("e", ""), ("n", None), ("0", None)]
    docs = [(i, prose(rng, 40)) for i in range(6)] + [(10, f"{prose(rng, 5)} {items[0][1].upper()} end"), (11, items[1][1]), (12, " ".join(items[4][1].split()[:10])), (13, None), (14, ""), (10, "again " + items[2][1])]
    cut = lambda s: WORDS.findall((s or "").encode().lower())
    want = []
    for d, x in docs:
        w, hit, found = cut(x), set(), set()
        for i, y in items:
            v = cut(y)
            n = min(10, len(v))
            for j in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[j : j + n]:
                        hit |= set(range(p, p + n))
                        found.add(i)
        want.append((d, len(w), len(hit), sorted(found)))
    for limit in (2_000_000, 0):  # with the filter, and with all hashes joined
        got = decontamination.decontaminate(frame(spark, docs), frame(spark, items, "item_id string, text string"), limit)
        assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()) == sorted(want)
    none = decontamination.decontaminate(frame(spark, docs), frame(spark, [], "item_id string, text string"))
    assert [r.n_hit for r in none.collect()] == [0] * len(docs)


def test_simhash_components(spark):
    rows = corpus(8)
    fps = []
    for _, x in rows:
        w = (x or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in sh) for b in range(64)]
        fps.append(sum(1 << b for b in range(64) if 2 * bits[b] > len(sh)))
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                comp = [comp[j] if c == comp[i] else c for c in comp]
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in comp}
    want = sorted(((rows[i][0], fps[i], least[comp[i]]) for i in range(len(rows))), key=repr)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.cluster(frame(spark, rows)).collect()), key=repr)
    assert got == want


def test_simhash_large_bucket_in_blocks(spark):
    rng = random.Random(9)
    center = rng.getrandbits(64)
    fps = list({center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)})
    classes = frame(spark, [(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    got = {r.node % (1 << 64): r.component % (1 << 64) for r in components(simhash.near_links(classes, len(fps), bucket=16)).collect()}
    comp = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 4 and comp[a] != comp[b]:
                x, y = comp[a], comp[b]
                comp = {k: x if v == y else v for k, v in comp.items()}
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups({f: got.get(f, f) for f in fps}) == groups(comp)


def test_components_of_a_path(spark):
    e = frame(spark, [(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    assert {r.node: r.component for r in components(e).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_mixing_meets_targets(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, rng.randint(1, 60)) if i % 50 else None, rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(900)]
    docs = frame(spark, [*rows, rows[0], rows[1]], f"{DOCS}, source string")
    got = mixing.mix(docs, block=32).collect()
    assert len(got) == 902
    again = mixing.mix(docs.repartition(3), block=32).collect()
    key = lambda r: (r.doc_id, r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    by: dict[tuple, int] = {}
    for r in got:
        assert r.taken <= 2 * r["size"]
        by[r.source_size, r.target] = by.get((r.source_size, r.target), 0) + r.taken
    total = sum(s for s, _ in by)
    assert sum(x for _, x in by) == pytest.approx(1.5 * total)
    for (size, target), taken in by.items():
        assert target <= 2 * size + 1e-6
        assert abs(taken - target) <= 0.06 * size + 60


def test_target_filling(spark):
    sizes = frame(spark, [("a", 100), ("b", 10), (None, 50)], "source string, size bigint")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got == pytest.approx({"a": 132.0, "b": 20.0, None: 88.0})


def test_quality_rules(spark):
    rng = random.Random(11)
    good = [(i, "Plain text that reads well, " + prose(rng, 50)) for i in range(150)]
    bad = [(1000 + i, " ".join(w + rng.choice(["###", "%%%"]) for w in prose(rng, 40).split())) for i in range(150)]
    labels = frame(spark, [(d, 1.0) for d, _ in good] + [(d, 0.0) for d, _ in bad], "doc_id bigint, label double")
    rows = good + bad + [(5000, None), (5001, "")]
    got = {r.doc_id: r.score for r in quality.classify(frame(spark, rows), labels).collect()}
    assert min(got[d] for d, _ in good) > max(got[d] for d, _ in bad)
    assert all(0 <= s <= 1 for s in got.values()) and got[5000] == got[5001]
    clash = frame(spark, [(*r, 1, "x") for r in rows], f"{DOCS}, upper int, row string")
    kept = quality.keep_good(clash, labels)
    assert kept.columns == clash.columns
    assert {r.doc_id for r in kept.collect()} >= {d for d, _ in good}
    none = quality.classify(frame(spark, rows), labels.limit(0))
    assert {r.score for r in none.collect()} == {0.5}
    assert quality.classify(frame(spark, []), labels).count() == 0


def test_toxicity_lexicon(spark):
    rng = random.Random(12)
    rows = [(i, f"{prose(rng, 20)} {rng.choice(['idiot', 'moron', 'scum']) if i % 3 == 0 else ''} {prose(rng, 20)}") for i in range(400)]
    labels = frame(spark, [(d, float(d % 3 == 0)) for d, _ in rows], "doc_id bigint, label double")
    docs = frame(spark, rows)
    lex = toxicity.learn(docs, labels)
    asked = [(1, "what an IDIOT you are"), (2, "an id1ot and a m0r0n"), (3, "іdiot"), (4, "pond scum in a lake"), (5, "a calm day"), (6, None), (7, ""), (8, "x " * 20000 + "moron")]
    got = {r.doc_id: r for r in toxicity.score(frame(spark, asked), lex).collect()}
    assert all(got[i].total > 0 for i in (1, 2, 3, 8)) and all(got[i].total == 0 for i in (4, 5, 6, 7))
    assert got[1].score > 0.5 > got[5].score and got[1].density > got[8].density
    empty = toxicity.learn(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, empty).collect()} == {0.5}


def test_spot_signatures(spark):
    rows = [r for r in corpus(13) if r[0] != 86]
    got = spotsigs.edited(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0), reverse=True)
    order = [r for _, r in sorted(enumerate(order), key=lambda p: (-(10**9 if p[1][0] is None else p[1][0]), p[1][1] or ""))]
    want = []
    for i, (d, x) in enumerate(order):
        x, y = x or "", order[(i + 1) % len(order)][1] or ""
        n = len(x)
        want.append((d, n, hashlib.sha256((x[: n - n // 2] + y[: n // 2]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    same = {r.doc_id: r.fingerprint for r in got}
    assert all(same[60 + i] == same[i] for i in range(8) if i not in (3, 5))


def test_similar_pairs(spark):
    text = " ".join(f"the c{i} d{i} of e{i} f{i}" for i in range(40))
    rows = [(1, text), (2, text), (3, text.replace("c5", "zz")), (4, "the other text is of no use")]
    assert [(r.a, r.b) for r in spotsigs.similar_pairs(frame(spark, rows)).collect()] == [(1, 3)]


PAGE = '<html><head><title>t</title><script>var a = "<p>no</p>"</script></head><body><nav><ul><li><a href="/x">menu</a></ul></nav><div class="notice">We moved</div><div class="post"><h1>{0} &amp; co</h1><p>First   <b>part</b> {0}<p>second&nbsp;part</div><div class="comments"><p>nice</p></div><footer>foot {0}</footer>'


def test_html_main_text(spark):
    rows = [(i, "http://a.example/x", PAGE.format(f"page{i}")) for i in range(5)]
    rows += [(10, None, None), (11, "", ""), (12, "http://b.example/", "<p>only</p><p>text &copy; <!-- no"), (13, "http://b.example/", "no markup at all"), (10, "http://c.example", "<div")]
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.extract(frame(spark, rows, "page_id bigint, url string, html string")).collect()}
    assert got[0, "http://a.example/x"][0] == "page0 & co\n\nFirst part page0\n\nsecond part"
    assert got[10, None] == ("", 0) and got[11, ""] == ("", 0)
    assert got[12, "http://b.example/"][0].startswith("only\n\ntext ©")
    assert got[13, "http://b.example/"][0] == "no markup at all"


def test_html_template_without_marks(spark):
    page = "<body><div><p>Always the same words</p></div><section><p>{0} story</p></section></body>"
    rows = [(i, "http://a.example/", page.format(f"page{i}")) for i in range(12)]
    got = html_text.extract(frame(spark, rows, "page_id bigint, url string, html string")).collect()
    assert sorted(r.text for r in got) == sorted(f"page{i} story" for i in range(12))


def test_tree_matching():
    a, b = "0 \n1 body\n2 nav\n2 div\n3 p", "0 \n1 body\n2 div\n3 p\n2 footer"
    assert html_text.align(a, b) == (0, 1, -1, 2, 3)


def test_licenses(spark):
    rows = [(1, "Licensed under CC BY-NC 4.0."), (2, "GNU General\nPublic. License; all rights reserved. ALL RIGHTS RESERVED"), (3, None), (4, ""), (5, "general license public cc, by"), (6, "released under the MIT License"), (7, "K" + "cc by"), (1, "none here"), (8, "filler " * 5000 + "cc by")]
    got = {(r.doc_id, r.n_words): r for r in licenses.scan(frame(spark, rows)).collect()}
    r = got[2, 10]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.score) == (3, 1, 7, "gpl,reserved", 1.0)
    assert got[1, 7].base_labels == "cc-by" and "cc-by-nc" in got[1, 7].labels
    assert (got[3, 0].n_base, got[3, 0].first_word, got[3, 0].labels, got[3, 0].score) == (0, None, "", 0.0)
    assert got[5, 5].base_labels == "cc-by" and got[6, 5].labels == "mit"
    assert got[7, 2].n_base == 0
    assert got[8, 5002].first_word == 5000


@pytest.mark.parametrize(
    "run",
    [
        lambda s, e: substring.dedup(e), lambda s, e: byte_dedup.dedup(e), lambda s, e: simhash.cluster(e), lambda s, e: spotsigs.edited(e), lambda s, e: licenses.scan(e),
        lambda s, e: mixing.mix(s.createDataFrame([], f"{DOCS}, source string")), lambda s, e: html_text.extract(s.createDataFrame([], "page_id bigint, url string, html string")),
        lambda s, e: decontamination.decontaminate(e, s.createDataFrame([("1", "a b c")], "item_id string, text string")),
    ],
)
def test_empty_tables(spark, run):
    assert run(spark, spark.createDataFrame([], DOCS)).count() == 0


def named_alike(seed: int = 21) -> list[tuple]:
    """Null and equal doc_ids on texts of several lengths that share passages among each other and with others, and that repeat in themselves."""
    rng = random.Random(seed)
    shared = [prose(rng, 80) for _ in range(3)]
    docs = [(i, f"{prose(rng, rng.randint(0, 30))} {shared[i % 3]} {prose(rng, rng.randint(0, 90))}") for i in range(4)]
    docs += [(d, f"{prose(rng, rng.randint(0, 120))} {rng.choice(shared)} {prose(rng, rng.randint(0, 9))}") for d in (None, 2, 7, 7) for _ in range(6)]
    docs += [(d, prose(rng, n)) for d in (None, 7) for n in (3, 60, 200)]
    among = prose(rng, 90)
    docs += [(None, f"{prose(rng, i)} {among} {prose(rng, 5)} {among[:400]} end {i}") for i in range(25)]
    return [*docs, (None, shared[0]), (None, None), (None, ""), (7, None), (None, shared[0])]


@pytest.mark.parametrize(("cap", "hot", "often"), [(None, 16, 0), (200, 16, 0), (None, 1, 0), (None, 16, 10**9)])
def test_null_and_equal_ids_lose_their_own_repeats_only(spark, cap, hot, often, monkeypatch):
    if often:
        count_frequent(monkeypatch, often)
    if hot < 16:
        monkeypatch.setattr(repeats, "_anchor_rows", wide_anchor_rows(hot))
    if cap:
        monkeypatch.setattr(repeats.repeats, "__defaults__", (cap,))
    rows = named_alike()
    key = lambda d: 10**9 if d is None else d
    cut = {True: lambda x: tuple((x or "").encode().split()), False: lambda x: (x or "").encode()}
    for words, n in ((True, 50), (False, 100)):
        texts = [(d, cut[words](x)) for d, x in rows]
        first: dict = {}
        for d, w in texts:
            for i in range(len(w) - n + 1):
                first[w[i : i + n]] = min(key(d), first.get(w[i : i + n], 10**10))
        want = []
        for d, w in texts:
            gone, own = set(), set()
            for i in range(len(w) - n + 1):
                if first[w[i : i + n]] < key(d) or (not words and w[i : i + n] in own):
                    gone |= set(range(i, i + n))
                own.add(w[i : i + n])
            kept = [v for i, v in enumerate(w) if i not in gone]
            want.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept) if words else bytes(kept)).hexdigest()))
        if words:
            got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(frame(spark, rows)).collect()]
        else:
            got = [(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in byte_dedup.dedup(frame(spark, rows)).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_near_duplicates_of_null_and_equal_ids(spark):
    import corpus_pipeline

    rng = random.Random(22)
    a, b, c, d, e, f = (prose(rng, 120) for _ in range(6))
    rows = [(None, a), (None, b), (None, a), (5, c), (5, d), (6, c), (None, d), (7, e), (8, f), (None, f)]
    got = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()
    want = [(None, a), (None, b), (5, c), (5, d), (7, e), (8, f)]
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(want, key=repr)


def test_html_containers_do_not_switch_off_their_article():
    page = "<body{0}><nav>menu</nav><div{1}><form{2}><article{3}><p>the whole story</p><div class='comments'>nice</div></article></form></div><p>imprint</p></body>"
    for at, name in enumerate((" class='has-sidebar'", " class='page no-ads'", " id='aspnetForm'", " class='post comments-open'")):
        assert html_text.main_text(page.format(*[name if i == at else "" for i in range(4)])) == "the whole story"
    assert html_text.main_text("<main><p>the whole story</p></main><aside><article>more</article></aside>") == "the whole story"
