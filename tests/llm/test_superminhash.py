"""SuperMinHash near-duplicates against all pairs in plain Python."""

from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplemark.llm import superminhash as s
from ripplemark.llm.oracles import OP13

SCHEMA = "doc_id bigint, text string"


def shingles(text: str | None) -> set:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return set()
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))}


def brute(rows) -> list[tuple]:
    sets = [shingles(t) for _, t in rows]
    least = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    parts = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                old, new = parts[i], parts[j]
                parts = [new if p == old else p for p in parts]
    out = []
    for i, (d, _) in enumerate(rows):
        c = rows[min((j for j in range(len(rows)) if parts[j] == parts[i]), key=least)][0]
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["The", "river", "été", "old", "Stone", "bridge", "ran", "low", "warm", "night"]) + str(rng.randint(0, 9)) for _ in range(n))


def edited(rng: random.Random, text: str, share: float) -> str:
    words = text.split(" ")
    return " ".join(w if rng.random() > share else f"new{rng.randint(0, 99)}" for w in words)


def rows(seed: int = 1) -> list[tuple]:
    rng, out = random.Random(seed), []
    for _ in range(25):
        base = prose(rng, rng.choice([3, 8, 40, 90, 200]))
        out += [base, base.upper(), *(edited(rng, base, rng.choice([0.01, 0.03, 0.06])) for _ in range(rng.randint(0, 9)))]
    out += [prose(rng, n) for n in (1, 2, 2, 3, 4)] + ["one two", "ONE  two\n", None, "", " \t", " ", " "]
    ids = list(range(len(out)))
    rng.shuffle(ids)
    data = list(zip(ids, out, strict=True))
    return [*data, (None, out[0]), (None, out[60]), (None, None), (ids[3], prose(rng, 30)), (ids[3], prose(rng, 30)), (2**62, prose(rng, 40_000))]


def run(spark, data, **how):
    df = spark.createDataFrame(data, SCHEMA).withColumns({"a": F.lit("x"), "n": F.lit(1), "component": F.lit(None).cast("int"), "places": F.lit(2)})
    got = s.cluster(df, **how).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize(("block", "weight"), [(2048, 16 << 20), (3, 16 << 20), (2048, 4000)])
def test_equals_all_pairs(spark, block, weight):
    data = rows()
    assert run(spark, data, block=block, weight=weight) == brute(data)


def test_no_rows_and_empty_texts(spark):
    assert run(spark, []) == []
    assert run(spark, [(2, None), (1, ""), (None, " ")]) == sorted([(2, 0, 2, True), (1, 0, 1, True), (None, 0, None, True)], key=repr)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = prose(rng, 300)
    data = [(i, edited(rng, base, 0.01)) for i in range(300)]
    assert run(spark, data, block=64) == brute(data)


def plain_signature(own: np.ndarray, places: int) -> list[float]:
    """The same draws, element by element, with a permutation kept whole and no early stop."""
    best = [float("inf")] * places
    for e in own:
        order = list(range(places))
        for j in range(places):
            a, b = (np.array([(int(e) + s.STEP * (2 * j + i)) % (1 << 64)], np.uint64) for i in (1, 2))
            r, k = float(s.t.mix(a)[0] >> np.uint64(11)) * 2.0**-53, j + int(s.t.mix(b)[0] % np.uint64(places - j))
            order[j], order[k] = order[k], order[j]
            best[order[j]] = min(best[order[j]], r + j)
    return best


def test_steps_over_many_sets_equal_plain_superminhash():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 5, 40, 300)]
    got = s.signatures([sets[0], np.zeros(0, np.uint64), *sets[1:]], 24)
    assert np.isinf(got[1]).all()
    for row, own in zip(got[[0, 2, 3, 4, 5]], sets, strict=True):
        assert row.tolist() == pytest.approx(plain_signature(own, 24))


def test_agreeing_places_estimate_the_similarity_better_than_minhash():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(200):
        both = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
        a, b = s.signatures([np.unique(both[:110]), np.unique(both[10:])])
        errors.append((a == b).mean() - 100 / 120)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < (100 / 120) * (20 / 120) / s.PLACES * 0.9  # of independent ranks: J (1 - J) / places


def test_similar_pairs_share_a_band():
    rng = np.random.default_rng(6)
    missed = 0
    for _ in range(300):
        both = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        a, b = s.signatures([np.unique(both[:184]), np.unique(both[16:])])  # 168 of 200
        missed += not (a.reshape(s.BANDS, s.ROWS) == b.reshape(s.BANDS, s.ROWS)).all(axis=1).any()
    assert missed == 0


def test_sql_equals_all_pairs():
    data = [(i, t) for i, (_, t) in enumerate(rows(2)[:120])]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", data)
    assert sorted(con.execute(f"SELECT doc_id, n_shingles, component_id, kept FROM ({OP13})").fetchall(), key=repr) == brute(data)
