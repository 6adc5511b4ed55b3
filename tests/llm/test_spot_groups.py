"""Groups of alike spot signatures against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from ripplemark.llm import spot_groups, spotsigs

from .test_llm import DOCS, frame
from .test_more import brute_signatures, natural


def near_copies(seed: int, n: int = 24) -> list[tuple]:
    """Rows of chains of edits, with equal texts, equal and null ids, empty texts and texts without a common word."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = natural(rng, rng.randint(20, 160)).split()
        rows.append((10 * i, " ".join(words)))
        for j in range(1, 5):
            for _ in range(j):
                words[rng.randrange(len(words))] = f"new{rng.randint(0, 99)}"
            rows.append((10 * i + j, " ".join(words)))
    rows += [(1000, rows[0][1]), (None, rows[4][1]), (None, rows[9][1]), (20, rows[21][1]), (1001, None), (1002, ""), (1003, "no anchors here"), (1004, "no anchors here"), (None, "apart und allein im feld")]
    return [*rows, rows[7]]


def brute_groups(rows: list[tuple]) -> list[tuple]:
    sets = [frozenset(brute_signatures(x or "")) for _, x in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if part[i] != part[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old = part[j]
                part = [part[i] if p == old else p for p in part]
    least: dict[int, int | None] = {}
    for p, (d, _) in zip(part, rows, strict=True):
        known = least.get(p)
        least[p] = d if known is None else known if d is None else min(known, d)
    return sorted(((d, x or "", least[p]) for p, (d, x) in zip(part, rows, strict=True)), key=repr)


def found(spark, rows: list[tuple], **kw) -> list[tuple]:
    texts = {xxhash.xxh64_intdigest((x or "").encode(), 42): x or "" for _, x in rows}
    return sorted(((r.doc_id, texts[r.text_a % (1 << 64)], r.component_id) for r in spot_groups.groups(frame(spark, rows), **kw).collect()), key=repr)


@pytest.mark.parametrize("kw", [{}, {"block": 4, "weight": 2000}])
def test_groups_against_brute_force(spark, kw):
    rows = near_copies(3)
    want = brute_groups(rows)
    assert found(spark, rows, **kw) == want
    assert 10 < len({c for _, _, c in want}) < len(rows) - 60


def test_the_order_of_signatures_does_not_matter(spark, monkeypatch):
    monkeypatch.setattr(spot_groups, "ORDER", 1)  # all texts are counted
    rows = near_copies(4, 10)
    assert found(spark, rows) == brute_groups(rows)


def test_fingerprints_tell_their_group(spark):
    rows = near_copies(5, 6)
    docs = frame(spark, rows)
    got = spotsigs.edited(docs, spot_groups.groups(docs)).collect()
    plain = spotsigs.edited(docs).collect()
    assert sorted((r[:-1] for r in got), key=repr) == sorted(map(tuple, plain), key=repr)
    want = brute_groups(rows)
    assert sorted(((r.doc_id, len(brute), r.component_id) for r in got for brute in ["x" * r.n_chars]), key=repr) == sorted(((d, len(x), c) for d, x, c in want), key=repr)


def test_a_bound_never_prunes_an_alike_pair():
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 30, 700, 3000):
        own = np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint32))
        sets = [own, *(np.unique(np.r_[own[k:], rng.integers(0, 1 << 32, m, dtype=np.uint32)]) for k in range(0, max(1, n // 4), max(1, n // 20)) for m in (0, 1, n // 9))]
        pruned = np.array([spot_groups.unlike(spot_groups.records(sets, bits), 0, np.arange(len(sets))) for bits in (spot_groups.BITS, spot_groups.WIDE)]).any(axis=0)
        first = [set(s.tolist()) for s in spot_groups.first_signatures(sets, own[:3], np.array([9, 5, 7])[: len(own[:3])])]
        for j, s in enumerate(sets):
            if spotsigs.jaccard(own, s) >= 0.8:
                assert not pruned[j] and first[0] & first[j]


def test_one_group_of_many_near_copies(spark):
    words = natural(random.Random(7), 200).split()
    rows = [(i, " ".join([*words[: i % 200], f"edit{i}", *words[i % 200 :]])) for i in range(600)]
    assert {c for _, _, c in found(spark, rows, block=64)} == {0}


def test_empty_table_and_clashing_columns(spark):
    assert spot_groups.groups(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(i, "the same words of all", "x", "y") for i in range(3)]
    docs = spark.createDataFrame(rows, f"{DOCS}, component string, a string")
    assert {r.component_id for r in spot_groups.groups(docs).collect()} == {0}
