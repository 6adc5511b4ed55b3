"""The Merkle manifest against a tree built in plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from ripplemark.llm import merkle
from ripplemark.llm.oracles import OP11

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(digests: list[str], k: int) -> list[list[str]]:
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + k])) for i in range(0, len(out[-1]), k)])
    return out


def brute(rows, k: int = 2):
    by: dict = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    rows_of = {x: sorted(by[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in order}
    trees = {x: levels([leaf(r) for r in rows_of[x]], k) for x in order}
    top, out = levels([trees[x][-1][0] for x in order], k), []
    for g, x in enumerate(order):
        for i, r in enumerate(rows_of[x]):
            now, proof = leaf(r), ""
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                now = leaf((*r[:3], None if r[3] is None else r[3] + 1, r[4]))
            for tree, at in ((trees[x], i), (top, g)):
                for row in tree[:-1]:
                    run, j = row[at // k * k : at // k * k + k], at % k
                    proof += "".join(run[:j] + run[j + 1 :])
                    now = sha("".join([*run[:j], now, *run[j + 1 :]]))
                    at //= k
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], sha(proof), now, now == top[-1][0]))
    return sorted(out, key=repr)


def rows(n: int, seed: int = 1):
    rng = random.Random(seed)
    out = [(i, rng.choice(["a", None]), rng.choice(["en", "en", "dé", None, ""]), rng.choice([None, i]), rng.choice(["x" * (i % 9), "ü\n", None, ""])) for i in range(n)]
    return [*out, *([(None, None, "en", 3, "same")] * 3), (None, None, None, None, None), (5, "s", "en", 1, "t"), (5, "s", "en", 1, "u"), (-9, "s", "lone", 1, "long " * 200_000)]


def run(spark, data, **how):
    docs = spark.createDataFrame(data, SCHEMA)
    docs = docs.withColumns({"rank": F.lit(7), "grp": F.lit("x"), "path": F.lit(None).cast("string"), "leaf": F.lit("y"), "other": F.lit(1)})
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    other = F.when(tampered, merkle.digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")))
    got = merkle.manifest(docs, other=other, **how).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize(("n", "fanout", "height"), [(150, 2, 8), (60, 2, 2), (60, 3, 2), (0, 2, 8)])
def test_equals_brute_force(spark, n, fanout, height):
    data = rows(n)
    assert run(spark, data, fanout=fanout, height=height) == brute(data, fanout)


def test_single_leaf_and_no_leaf(spark):
    one = [(7, None, None, None, None)]
    got = run(spark, one)
    assert got == brute(one) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha("")
    assert run(spark, []) == []


def test_intervals_and_siblings(spark):
    """A proof holds, on each level, just what the parent's interval has besides the child's."""
    docs = spark.createDataFrame([(i, "s", "en", i, f"t{i}") for i in range(21)], SCHEMA)
    out = {r.rank: r for r in merkle.manifest(docs, height=2).collect()}
    tree = levels([out[i].leaf for i in range(21)], 2)
    for i, r in out.items():
        assert [(s.l, s.r) for s in r.path] == [(row[(i >> j) - 1], "") if (i >> j) % 2 else ("", row[(i >> j) + 1] if (i >> j) + 1 < len(row) else "") for j, row in enumerate(tree[:-1])]


def test_sql_equals_brute_force():
    data = [r for r in rows(40) if r[0] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", data)
    assert sorted(con.execute(OP11).fetchall(), key=repr) == brute(data)
