"""Row identity, methods against brute force, held-out labels, hostile inputs, and the pipeline's stages."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from ripplemark.llm import decontamination, html_text, licenses, mixing, quality, simhash, spotsigs, substring, toxicity
from ripplemark.llm import text as t
from ripplemark.llm.oracles import OP10
from tests.llm.test_llm import DOCS, WORDS, frame, prose

BIG = (1 << 63) - 1


# ---- winnowing


@pytest.mark.parametrize("ranked", [40, 57])
def test_equal_windows_choose_equal_grams_in_any_piece(ranked, monkeypatch):
    monkeypatch.setattr(t, "RANKED", ranked)  # 57: blocks of 128 grams
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    grams[rng.integers(0, 2000, 900)] = grams[7]  # ties
    grams[100:140] = (np.uint64(5) << np.uint64(24)) + np.arange(40, dtype=np.uint64)  # equal in the bits that rank
    whole = dict(zip(*(v.tolist() for v in t.winnow(grams, np.arange(2000, 0, -1), 31)), strict=True))
    assert len(whole) == 1970
    for low, high in ((0, 40), (95, 160), (500, 1999), (3, 1203)):
        starts, at = t.winnow(grams[low:high], np.arange(high - low, 0, -1), 31)
        assert len(starts) == high - low - 30
        assert all(whole[s + low] == p + low for s, p in zip(starts.tolist(), at.tolist(), strict=True))


def test_dedup_and_decontamination_do_not_depend_on_pieces(spark, monkeypatch):
    rng = random.Random(31)
    shared = prose(rng, 90)
    rows = [(i, f"{prose(rng, 3 * i)} {shared} {prose(rng, 500 * (i % 3))}") for i in range(12)]
    items = frame(spark, [("a", shared)], "item_id string, text string")
    want = None
    for chunk in (1 << 20, 300):
        monkeypatch.setattr(t, "CHUNK", chunk)
        got = [(r.doc_id, r.n_removed) for r in substring.dedup(frame(spark, rows)).collect()]
        found = [(r.doc_id, r.n_hit) for r in decontamination.decontaminate(frame(spark, rows), items).collect()]
        assert want is None or (sorted(got), sorted(found)) == want
        want = sorted(got), sorted(found)
    assert all(n >= 90 for d, n in want[0] if d) and all(n >= 90 for _, n in want[1])


def test_hits_of_a_long_text_come_in_batches_of_bounded_size(spark):
    text = "common " * 60_000
    batch = pa.RecordBatch.from_pydict({"rid": pa.array([4, 5], pa.int64()), "doc_id": pa.array([7, None], pa.int64()), "text": pa.array([text, None])})
    rows = list(decontamination._document_rows((1,), None)(iter([batch])))
    assert max(b.num_rows for b in rows) <= decontamination.ROWS
    assert sum(b.num_rows for b in rows) >= 60_002
    assert max(b.nbytes for b in rows) < 4 << 20
    items = frame(spark, [("one", "common"), ("two", "common"), ("three", "common common")], "item_id string, text string")
    got = decontamination.decontaminate(frame(spark, [(7, text), (8, "clean")]), items).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == [(7, 60_000, 60_000, ("one", "three", "two")), (8, 1, 0, ())]


def test_a_prompt_of_very_many_items(spark):
    rng = random.Random(37)
    prompt = prose(rng, 12)
    items = frame(spark, [(f"i{k:04}", f"{prompt} {prose(rng, 4)}") for k in range(400)], "item_id string, text string")
    got = decontamination.decontaminate(frame(spark, [(d, f"{prose(rng, 5)} {prompt} {prose(rng, 5)}") for d in range(50)]), items).collect()
    assert all(list(r["items"]) == [f"i{k:04}" for k in range(400)] and r.n_hit >= 12 for r in got)


# ---- identity of rows


def test_large_and_null_ids_survive(spark):
    rng = random.Random(32)
    ids = [*(2**60 + i for i in range(5)), BIG, None, None]
    rows = [(d, prose(rng, 30)) for d in ids]
    want = sorted(ids, key=repr)
    docs = frame(spark, [(*r, "a") for r in rows], f"{DOCS}, source string")
    assert sorted((r.doc_id for r in mixing.mix(docs).collect()), key=repr) == want
    for run in (lambda d: simhash.cluster(d), lambda d: spotsigs.edited(d), lambda d: substring.dedup(d)):
        assert sorted((r.doc_id for r in run(frame(spark, rows)).collect()), key=repr) == want
    got = {r.doc_id: r.component_id for r in simhash.cluster(frame(spark, [(BIG, rows[0][1]), (None, rows[0][1]), (None, rows[1][1])])).collect() if r.doc_id}
    assert got == {BIG: BIG}


def test_repeated_rows_do_not_fill_a_block(spark, monkeypatch):
    sizes: list[int] = []
    plain = mixing._rounded

    def spied(units):
        sizes.append(units.groupBy("source_no", "block").count().agg({"count": "max"}).first()[0] or 0)
        return plain(units)

    monkeypatch.setattr(mixing, "_rounded", spied)
    rows = [(1, "same words here", "a")] * 3000 + [(i, "other words", "b") for i in range(100)]
    got = mixing.mix(frame(spark, rows, f"{DOCS}, source string"), block=64).collect()
    assert len(got) == 3100 and max(sizes) < 200
    for source_size in {r.source_size for r in got}:
        own = [r for r in got if r.source_size == source_size]
        expected = len(own) * min(2.0, own[0].target / source_size)
        assert math.floor(expected) <= sum(r.copies for r in own) <= math.ceil(expected)


def test_equal_rows_fare_alike_however_the_table_is_split(spark):
    rng = random.Random(36)
    rows = [(1, "the same words", "a")] * 20_000 + [(i, prose(rng, i % 9), "ab"[i % 2]) for i in range(6000)] + [(7, "twice", "b")] * 2
    docs, results = frame(spark, rows, f"{DOCS}, source string").cache(), set()
    for parts in (1, 3, 7, 11):
        got = mixing.mix(docs.repartition(parts)).groupBy("doc_id", "size", "copies").count().collect()
        results.add(tuple(sorted(map(tuple, got))))
    assert len(results) == 1


def test_copies_add_up_in_every_source(spark):
    """Dependent rounding keeps a source's number of copies at its expectation, rounded down or up."""
    rng = random.Random(33)
    rows = [(i, prose(rng, rng.randint(0, 40)), rng.choice("abcde")) for i in range(700)]
    got = mixing.mix(frame(spark, rows, f"{DOCS}, source string"), block=16).collect()
    source = {d: s for d, _, s in rows}
    for s in "abcde":
        own = [r for r in got if source[r.doc_id] == s]
        expected = len(own) * min(2.0, own[0].target / own[0].source_size)
        assert math.floor(expected - 1e-6) <= sum(r.copies for r in own) <= math.ceil(expected + 1e-6)
        assert {r.copies for r in own} <= {math.floor(expected / len(own)), math.ceil(expected / len(own))}


# ---- licenses


def brute_labels(words: list[str]) -> tuple[int, set[str], float]:
    n, labels, best = 0, set(), 0.0
    for phrase, label in licenses.BASE:
        w = phrase.split()
        places = [i for i in range(len(words) - len(w) + 1) if words[i : i + len(w)] == w]
        n += len(places)
        if places:
            labels.add(label)
            best = 1.0
    for text, label in licenses.TEMPLATES:
        w = text.split()
        votes: dict[int, set[int]] = {}
        for i in range(len(words) - 1):
            for at in range(len(w) - 1):
                if words[i : i + 2] == w[at : at + 2]:
                    votes.setdefault(i - at, set()).add(at)
        for d in votes:
            own = sorted((e + at, at) for e in range(d, d + licenses.DRIFT + 1) for at in votes.get(e, ()))
            length: list[int] = []
            for k, (i, at) in enumerate(own):
                length.append(1 + max((length[m] for m in range(k) if own[m][0] < i and own[m][1] < at), default=0))
            best = max(best, max(length) / (len(w) - 1))
            if max(length) / (len(w) - 1) >= licenses.SHARE:
                labels.add(label)
    return n, labels, best


def test_words_in_another_order_are_no_license(spark):
    rng = random.Random(35)
    rows = [(0, "mit license the mit under the released under"), (1, "released under the mit license")]
    for text, _ in licenses.TEMPLATES:
        w = text.split()
        grams = [w[i : i + 2] for i in range(len(w) - 1)]
        rows.append((len(rows), " ".join(" ".join(g) for g in reversed(grams))))
        rows.append((len(rows), " ".join(" ".join([*g, *prose(rng, 4).split()]) for g in grams)))  # scattered
        rng.shuffle(grams)
        rows.append((len(rows), " ".join(" ".join(g) for g in grams)))
        rows.append((len(rows), " ".join([*grams[0] * 40, *w, *grams[-1] * 40])))  # whole, among repeated bigrams
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    for d, x in rows:
        n, labels, best = brute_labels(x.split())
        assert (got[d].n_base, got[d].labels) == (n, ",".join(sorted(labels)))
        assert got[d].score == pytest.approx(best)
    assert got[0].labels == "" and got[0].score <= 0.5 and got[1].labels == "mit"
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    twin = con.execute(f"SELECT doc_id, labels, score FROM ({OP10})").fetchall()
    assert {d: x for d, x, _ in twin} == {d: r.labels for d, r in got.items()}
    assert {d: x for d, _, x in twin} == pytest.approx({d: r.score for d, r in got.items()})


def test_licenses_against_brute_force(spark):
    rng = random.Random(34)
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 4)):
            w = rng.choice([*licenses.TEMPLATES, *licenses.BASE])[0].split()
            for _ in range(rng.randint(0, 3)):  # words that go or come
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choice(([], ["extra"], ["associated", "documentation"], ["of", "this"]))
            words += [*prose(rng, rng.randint(0, 12)).split(), *w]
        rows.append((i, " ".join(words)))
    mit = licenses.TEMPLATES[0][0].split()
    rows.append((500, " ".join([*mit[:9], "associated", "documentation", *mit[9:]])))
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    for d, x in rows:
        n, labels, best = brute_labels(x.split())
        assert (got[d].n_base, got[d].labels) == (n, ",".join(sorted(labels)))
        assert got[d].score == pytest.approx(best)
    assert "mit" in got[500].labels
    named = spark.createDataFrame([("Some License of some words, at some length", "some"), ("one", "one"), (None, "none")], "text string, label string")
    got = licenses.scan(frame(spark, [(1, "x SOME license of some words at some length"), (2, "one"), (3, None)]), templates=named).collect()
    assert sorted((r.doc_id, r.labels) for r in got) == [(1, "some"), (2, ""), (3, "")]


# ---- learned operators: labels that are held out play no part


def held(d: int) -> bool:
    return zlib.crc32(str(d).encode()) % 5 == 0


def labelled(seed: int) -> tuple[list[tuple], dict[int, float]]:
    rng = random.Random(seed)
    rows, labels = [], {}
    for i in range(400):
        labels[i] = float(rng.random() < 0.5)
        bad = " ".join(w + "###" for w in prose(rng, 30).split()) if labels[i] else f"Plain words, that read well. {prose(rng, 30)}."
        rows.append((i, f"{bad} {'idiot scum' if labels[i] else ''}"))
    return rows, labels


def test_scores_ignore_held_out_labels(spark):
    rows, labels = labelled(35)
    docs = frame(spark, [*rows, (3, None)])
    table = lambda m: frame(spark, [*m.items(), (None, 1.0), (7, None)], "doc_id bigint, label double")
    flipped = {d: 1 - v if held(d) else v for d, v in labels.items()}
    assert flipped != labels
    for run in (lambda m: quality.classify(docs, table(m)), lambda m: toxicity.score(docs, toxicity.learn(docs, table(m)))):
        a, b = (sorted((r.doc_id, r.score) for r in run(m).collect()) for m in (labels, flipped))
        assert a == b and len({s for _, s in a}) > 1


def test_repeated_labelled_ids_do_not_multiply(spark):
    rows, labels = labelled(36)
    table = frame(spark, list(labels.items()), "doc_id bigint, label double")
    once, often = frame(spark, rows), frame(spark, [*rows, *[rows[1]] * 500])
    for run in (lambda d: quality.classify(d, table), lambda d: toxicity.score(d, toxicity.learn(d, table))):
        a, b = ({(r.doc_id, round(r.score, 9)) for r in run(d).collect()} for d in (once, often))
        assert a == b


def test_rules_equal_their_tests(spark):
    """The compiled column against the rules read one by one."""
    rows, labels = labelled(37)
    docs = frame(spark, [*rows, (900, None), (901, ""), (902, "long " * 50_000)])
    table = frame(spark, list(labels.items()), "doc_id bigint, label double")
    stats = quality.statistics(docs.select("doc_id", "text")).drop("text")
    rules = quality.learn(stats, quality.chosen(table))
    assert rules.rules and all(r.tests for r in rules.rules)
    got = {r.doc_id: r.score for r in quality.classify(docs, table).collect()}
    for r in stats.collect():
        total = rules.bias + sum(rule.weight for rule in rules.rules if all((r[n] <= c) == most for n, most, c in rule.tests))
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-total)))


def test_matches_against_a_plain_search():
    rng = random.Random(38)
    lex = toxicity.Lexicon({" bad ": 2.0, " bad": 1.0, " evil": 3.0, " od ": 5.0}, ("bad luck", "evil eye bad"), (0.0, 1.0, 1.0))
    automaton = lex.automaton()
    for _ in range(300):
        words = [rng.choice(["bad", "badly", "evil", "evileye", "eye", "luck", "od", "good", "x"]) for _ in range(rng.randint(0, 30))]
        spared = set()
        for phrase in lex.exceptions:
            p = phrase.split()
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    spared |= set(range(i, i + len(p)))
        total = sum(max((w for e, w in lex.weights.items() if f" {v} ".startswith(e)), default=0.0) for i, v in enumerate(words) if i not in spared)
        assert toxicity._features(words, automaton)[0] == pytest.approx(total)
    assert toxicity._features(["evil", "eye", "bad", "luck"] * 20_000, automaton)[0] == 0


def test_learned_operators_on_empty_tables(spark):
    none, labels = frame(spark, []), frame(spark, [(1, 1.0)], "doc_id bigint, label double")
    assert toxicity.score(none, toxicity.learn(none, labels)).count() == 0
    assert quality.classify(none, labels).count() == 0
    assert quality.keep_good(none, labels).count() == 0


def test_other_columns_keep_their_values(spark):
    rows, labels = labelled(39)
    docs = frame(spark, [(*r, r[0], "x", "r") for r in rows], f"{DOCS}, upper int, row string, rid string")
    kept = quality.keep_good(docs, frame(spark, list(labels.items()), "doc_id bigint, label double"))
    assert kept.columns == docs.columns
    assert all(r.upper == r.doc_id and (r.row, r.rid) == ("x", "r") for r in kept.collect())


# ---- spot signatures


def brute_signatures(text: str) -> set:
    words = [w for w in "".join(" " if c in " \t\n\r\x0b\x0c" or (c.isascii() and not c.isalnum() and c > " " and c < "\x7f") else c.lower() if c.isascii() else c for c in text).split(" ") if w]
    common, out = set(spotsigs.COMMON), set()
    for i, w in enumerate(words):
        chain = [v for v in words[i + 1 :] if v not in common][: spotsigs.CHAIN]
        if w in common and len(chain) == spotsigs.CHAIN:
            out.add((w, *chain))
    return out or {tuple(words)}


def natural(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice([f"word{rng.randint(0, 60)}", rng.choice(("the", "of", "und", "la")), f"x{rng.randint(0, 9)},"]) for _ in range(n))


def test_likeness_against_brute_force(spark):
    rng = random.Random(40)
    rows = [(i, natural(rng, rng.randint(0, 80))) for i in range(60)] + [(None, natural(rng, 20)), (None, None), (7, natural(rng, 9)), (99, ""), (98, "the of la"), (97, natural(rng, 9000))]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(5, natural(rng, 30)) for _ in range(40)]
    got = spotsigs.edited(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts: dict[tuple, Counter] = {}
    for d, x in rows:
        texts.setdefault(d, Counter())[x or ""] += 1
    by: dict[str, frozenset] = {}
    for r in got:  # equal signature sets have equal fingerprints, and no others have
        if r.doc_id is not None and len(texts[r.doc_id]) == 1:
            s = frozenset(brute_signatures(next(iter(texts[r.doc_id]))))
            assert by.setdefault(r.fingerprint, s) == s
    assert len(set(by.values())) == len(by)
    order = sorted({d for d, _ in rows if d is not None and len(texts[d]) == 1}, reverse=True)
    single = {d: next(iter(texts[d])) for d in order}
    of = {r.doc_id: r for r in got if r.doc_id in single}
    known = sorted((d for d in texts if d is not None), reverse=True)
    for a, b in zip(known, known[1:]):
        if a in single and b in single:
            x, y = single[a], single[b]
            n = len(x)
            sx, se, sy = brute_signatures(x), brute_signatures(x[: n - n // 2] + y[: n // 2]), brute_signatures(y)
            assert of[a].near_next == pytest.approx(len(sx & sy) / len(sx | sy))
            assert of[a].near_edited == pytest.approx(len(sx & se) / len(sx | se))
    assert len(by) > 50


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(41)
    rows = []
    for i in range(30):
        words = natural(rng, 120).split()
        rows.append((10 * i, " ".join(words)))
        for j in range(1, 4):
            for _ in range(2 * j):
                words[rng.randrange(len(words))] = f"new{rng.randint(0, 99)}"
            rows.append((10 * i + j, " ".join(words)))
    rows += [(1000, rows[0][1]), (None, rows[4][1]), (1001, None), (1002, "")]
    first: dict[frozenset, int] = {}  # classes of equal sets, by their least doc_id
    for d, x in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(frozenset(brute_signatures(x or "")), d)
    sets = {d: s for s, d in first.items()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {(r.a, r.b) for r in spotsigs.similar_pairs(frame(spark, rows)).collect()}
    assert len(want) > 10 and got == want


def test_an_id_of_many_rows_is_cut(spark):
    rows = [(None, f"text number {i} of the null ones") for i in range(600)] + [(i, f"text {i}") for i in range(50)]
    assert spotsigs.edited(frame(spark, rows)).count() == 650


# ---- HTML


@pytest.mark.parametrize(
    "page",
    ["<a" * 500_000, "<div>" * 60_000 + "deep", '<a "<b >"' * 60_000, "<button>" * 60_000, "<div>" * 30_000 + "</p></span></td>" * 30_000, "a < b " * 100_000, "<!--" * 100_000, "</" * 200_000 + ">", "<p>x" * 100_000]
    + ["".join(f"<div class='{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}'>t</div>" for i in range(676))],
)
def test_broken_pages_end(page):
    tree, _ = html_text.skeleton(html_text.parse(page))
    assert list(html_text.align(tree, tree)) == list(range(tree.count("\n") + 1))
    assert isinstance(html_text.main_text(page), str)


def brute_matching(a: tuple, b: tuple) -> int:
    """Nodes of the best simple tree matching of two trees (label, children)."""
    if a[0] != b[0]:
        return 0
    m = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1], 1):
        for j, y in enumerate(b[1], 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + brute_matching(x, y))
    return m[-1][-1] + 1


def random_tree(rng: random.Random, depth: int = 3) -> tuple:
    return (rng.choice("ab"), [random_tree(rng, depth - 1) for _ in range(rng.randint(0, 4))] if depth else [])


def written(tree: tuple, depth: int = 0) -> list[str]:
    return [f"{depth} {tree[0]}", *(line for c in tree[1] for line in written(c, depth + 1))]


def test_tree_matching_against_brute_force():
    rng = random.Random(42)
    for _ in range(300):
        a, b = random_tree(rng), random_tree(rng)
        la, lb = written(a), written(b)
        found = html_text.align("\n".join(la), "\n".join(lb))
        used = [x for x in found if x >= 0]
        assert len(used) == brute_matching(a, b) == len(set(used))
        assert all(la[i] == lb[x] for i, x in enumerate(found) if x >= 0) and used == sorted(used)
        merged = html_text.merge("\n".join(lb), "\n".join(la)) if a[0] == b[0] else None
        if merged:
            assert len(merged.split("\n")) == len(la) + len(lb) - len(used)


def test_content_regions_are_induced_without_marks(spark):
    """No article or main tag and no telling class: what repeats goes, and so do small varying parts outside of the region."""
    rng = random.Random(43)
    page = "<body><div class='zz'><p>{a}</p><p>Always here</p></div><section><h2>{t}</h2><p>{b}</p><p>{c}</p><p>Share this page</p></section><div>{a} at {a}</div></body>"
    parts = [{k: prose(rng, n) for k, n in (("a", 1), ("t", 4), ("b", 60), ("c", 40))} for _ in range(15)]
    rows = [(i, "http://a.example/x", page.format(**p)) for i, p in enumerate(parts)] + [(90, "http://a.example/y", rows_page := page.format(**parts[0])), (91, "http://a.example/", None)]
    assert rows_page
    got = {r.page_id: r.text for r in html_text.extract(frame(spark, rows, "page_id bigint, url string, html string")).collect()}
    for i, p in enumerate(parts):
        assert got[i] == "\n\n".join((p["t"], p["b"], p["c"]))
    assert got[90] == got[0] and got[91] == ""


def test_trees_of_a_host_are_merged_in_turns(spark):
    shapes = [("h", f"0 \n1 body\n2 p\n2 div.{chr(97 + i % 26)}{chr(97 + i // 26)}\n3 p", 1) for i in range(60)] + [("k", "0 \n1 body", 3)]
    got = {r.host: r.tree.split("\n") for r in html_text.host_trees(spark.createDataFrame(shapes, "host string, shape string, n bigint"), fanin=4).collect()}
    assert len(got["h"]) == 3 + 2 * 60 and got["k"] == ["0 ", "1 body"]


# ---- the pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small set of tables with every kind of case."""
    rng = random.Random(44)
    rows, labels = labelled(45)
    item = prose(rng, 14)
    shared = prose(rng, 60)
    docs = [(d, x, "en", rng.choice("ab"), len(x)) for d, x in rows[:120]]
    docs += [(1000 + i, f"Plain words, that read well. {prose(rng, 80)}. {shared if i % 3 == 0 else ''} {item if i % 7 == 0 else ''} {prose(rng, 9)}.", "en", rng.choice(["a", "b", None]), 1) for i in range(60)]
    docs += [(2000 + i, docs[130 + i][1], "de", "a", 5) for i in range(6)] + [(None, docs[150][1], "de", "b", 5), (None, f"Plain words, that read well. {prose(rng, 70)}.", "fr", "b", 0), (1003, f"Plain words, that read well. {prose(rng, 50)}.", "en", "a", 0), (3000, None, None, None, None), (3001, "", "en", "a", 0)]
    docs += [docs[140]] * 3
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, int(1 - v), int(v)) for d, v in labels.items()], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("i", item), ("j", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain_rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_against_brute_force(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    # 1: scores by the operator, which its own tests hold against the rules
    good = corpus_pipeline.staged(corpus_pipeline.quality(spark, docs, folder))
    labels = spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id", "cast(quality as double) AS label")
    scores = {r.rid: r.score for r in quality.classify(docs, labels).collect()}
    assert good.count() == sum(s >= quality.THRESHOLD for s in scores.values()) > 60
    # 2: one of each group within 4 bits
    rows = good.collect()
    fps = [simhash.fingerprint(r.text) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((r.doc_id is None, r.doc_id or 0) for r, h in zip(rows, group, strict=True) if h == g) for g in set(group)}
    near = corpus_pipeline.staged(corpus_pipeline.near_duplicates(spark, good, folder))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in near.collect()) == sorted(least.values())
    # 3: windows of 50 words that a smaller doc_id has
    rows, seen = near.collect(), {}
    key = lambda r: BIG if r.doc_id is None else r.doc_id
    for r in rows:
        w = (r.text or "").split()
        for i in range(len(w) - 49):
            x = tuple(w[i : i + 50])
            seen[x] = min(key(r), seen.get(x, BIG + 1))
    want = []
    for r in rows:
        w = (r.text or "").split()
        gone = {j for i in range(len(w) - 49) if seen[tuple(w[i : i + 50])] < key(r) for j in range(i, i + 50)}
        rest = " ".join(v for j, v in enumerate(w) if j not in gone)
        if not gone:
            want.append(tuple(r))
        elif rest:
            want.append((r.doc_id, rest, r.lang, r.source, len(rest)))
    subs = corpus_pipeline.staged(corpus_pipeline.substrings(spark, near, folder))
    assert plain_rows(subs) == sorted(want, key=repr) and subs.columns == docs.columns
    # 4: windows of 10 words of an item
    item = next(r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text).split()
    windows = {tuple(x.encode() for x in item[i : i + 10]) for i in range(len(item) - 9)}
    cut = lambda x: WORDS.findall((x or "").encode().lower())
    want = [tuple(r) for r in subs.collect() if not any(tuple(w[i : i + 10]) in windows for w in [cut(r.text)] for i in range(len(w) - 9))]
    clean = corpus_pipeline.staged(corpus_pipeline.decontamination(spark, subs, folder))
    assert plain_rows(clean) == sorted(want, key=repr) and len(want) < subs.count()
    # 5: copies at the sources' expectation, rounded down or up
    mixed = corpus_pipeline.mixing(spark, clean, folder).collect()
    every = clean.collect()
    size = Counter()
    for r in every:
        size[r.source] += len((r.text or "").split())
    target = {(None if r.source is None else r.source): r.target for r in mixing.targets(spark.createDataFrame([(s, n) for s, n in size.items()], "source string, size bigint")).collect()}
    for s in size:
        n = sum(r.source == s for r in every)
        expected = n * min(2.0, target[s] / size[s]) if size[s] else 0
        assert math.floor(expected - 1e-6) <= sum(r.mix_copies for r in mixed if r.source == s) <= math.ceil(expected + 1e-6)
    assert all(r.mix_taken == r.mix_copies * len((r.text or "").split()) for r in mixed)


def test_pipeline_runs_whole_and_on_nothing(spark, folder, tmp_path):
    import corpus_pipeline

    a, b = (sorted(((r.doc_id, r.mix_copies) for r in corpus_pipeline.run(spark, folder).collect()), key=repr) for _ in range(2))
    assert a == b and len(a) > 20
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_numbers_of_rows(spark, folder, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "lang AS _metadata", "lang AS path", "doc_id AS rid", "doc_id AS at")
    docs.repartition(5).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert corpus_pipeline._places(docs) is not None
    split = [("spark.sql.files.maxPartitionBytes", "128m"), ("spark.sql.files.maxPartitionBytes", "2k")]
    numbers = []
    for k, v in split:  # however the files are split between tasks
        spark.conf.set(k, v)
        try:
            numbers.append({r.rid: (r.doc_id, r.text) for r in corpus_pipeline._numbered(docs).collect()})
        finally:
            spark.conf.unset(k)
    assert numbers[0] == numbers[1] and len(numbers[0]) == docs.count()
    # rows of a join, a union or no files have no places: they are numbered in a written copy
    for other in (docs.unionAll(docs), docs.join(docs.select("source").distinct(), "source"), docs.filter("doc_id > 3"), spark.createDataFrame(docs.collect(), docs.schema)):
        assert corpus_pipeline._places(other) is None
        got = corpus_pipeline._numbered(other)
        assert got.select("rid").distinct().count() == got.count() == other.count()
    assert spark.read.parquet(f"{tmp_path}/docs").filter("1 = 0").count() == corpus_pipeline._numbered(docs.limit(0)).count() == 0


def test_stages_hand_on_columns_of_any_name(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    odd = docs.selectExpr("*", "doc_id AS rid", "lang AS row", "source AS fp", "lang AS known", "n_chars AS size", "lang AS spans", "n_chars AS rest", "lang AS mix", "lang AS mix_copies", "lang AS Mix_Taken")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, folder)
        assert out.columns[: len(odd.columns)] == odd.columns, name
        for r in out.collect():
            assert (r.rid, r.row, r.fp, r.known, r.mix_copies) == (r.doc_id, r.lang, r.source, r.lang, r.lang), name
    assert out.columns[-2:] == ["_mix_copies", "_mix_taken"]
    assert corpus_pipeline.mixing(spark, docs.drop("source"), folder).columns[-2:] == ["mix_copies", "mix_taken"]


def test_long_texts_of_every_operator(spark):
    long = " ".join(f"word{i % 997} the" for i in range(60_000))
    docs = frame(spark, [(1, long), (2, "short text"), (3, long)])
    assert {r.doc_id: r.n_removed for r in substring.dedup(docs).collect()} == {1: 0, 2: 0, 3: 120_000}
    assert len({r.component_id for r in simhash.cluster(docs).collect()}) == 2
    assert {r.n_words for r in decontamination.decontaminate(docs, frame(spark, [("i", "short text")], "item_id string, text string")).collect()} == {120_000, 2}
    got = {r.doc_id: r for r in spotsigs.edited(docs).collect()}
    assert got[1].fingerprint == got[3].fingerprint and got[1].n_chars == len(long)
    page = f"<body><nav>menu</nav><article><p>{long}</p></article>"
    assert html_text.main_text(page) == long
    sized = frame(spark, [(1, long, "a"), (2, "short text", "a"), (3, long, None)], f"{DOCS}, source string")
    assert sorted((r.doc_id, r.size) for r in mixing.mix(sized).collect()) == [(1, 120_000), (2, 2), (3, 120_000)]
    stats = {r.doc_id: r for r in quality.statistics(docs).collect()}
    assert stats[1][1:] == stats[3][1:] != stats[2][1:]
    found = licenses.scan(frame(spark, [(1, f"{long} released under the mit license")])).collect()
    assert [(r.n_words, r.labels) for r in found] == [(120_005, "mit")]


def test_pages_cut_inside_a_tag_leave_no_markup():
    assert html_text.main_text("<p>hello world <a href='x") == "hello world"
    assert html_text.main_text("<p>hello <b>world</b> <!-- note") == "hello world"
    assert html_text.main_text("<p>hello</p").strip() == "hello"
    assert html_text.main_text("<p>1 < 2 and 3 <4") == "1 < 2 and 3 <4"


def site(rng: random.Random, host: str, n: int, marked: bool) -> tuple[list[tuple], dict[str, str]]:
    """Pages of one layout, and the text that each was made from."""
    pages, truth = [], {}
    line = " ".join(prose(rng, 6).split())
    for i in range(n):
        blocks = [" ".join(prose(rng, rng.randint(12, 60)).split()) for _ in range(rng.randint(1, 5))]
        url = f"http://{host}/{i}"
        inner = "".join(f"<p>{b}</p>" for b in blocks)
        body = f"<article>{inner}</article>" if marked else f"<div id='c7'><div>{inner}</div></div>"
        pages.append((url, f"<html><head><title>t {i}</title><style>p {{}}</style></head><body><div class='nav'><a href='/'>home</a> <a>{line}</a></div>{body}<script>var a = {i};</script><div class='footer'>{line} {i}</div></body></html>"))
        truth[url] = "\n\n".join(blocks)
    return pages, truth


def test_texts_of_pages_whose_content_is_known(spark):
    rng, pages, truth = random.Random(38), [], {}
    for n in (1, 2, 3, 5, 12):
        for marked in (True, False):
            if n > 1 or marked:
                own, texts = site(rng, f"h{n}{marked}.example", n, marked)
                pages, truth = [*pages, *own], truth | texts
    rows = frame(spark, [(i, *p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    assert {r.url: r.text for r in html_text.extract(rows).collect()} == truth
    hosts = {r.host for r in html_text.wrappers(rows.selectExpr("parse_url(url, 'HOST') AS host", "html")).collect()}
    assert hosts == {u.split("/")[2] for u in truth if not u.startswith("http://h1True")}
