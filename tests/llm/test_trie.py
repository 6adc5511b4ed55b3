"""The trie of conversations against prefixes counted in plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from ripplemark.llm import prefix_trie
from ripplemark.llm.oracles import OP12

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def code(turn: tuple[str, str]) -> str:
    return sha(f"{len(turn[0].encode())}:{turn[0]}{turn[1]}")


def brute(rows):
    own: dict = {}
    for c, n, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((n is not None, n or 0, code((role or "", text or "")), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    nodes: dict = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        seq = (*own.get(base, [])[:h], *turns[h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], [[], []])[0].append(c)
        nodes[seq][1].append(c)
    kids: dict = {}
    for seq in nodes:
        if seq:
            kids[seq[:-1]] = kids.get(seq[:-1], 0) + 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for seq, (members, _) in nodes.items():
        for d in range(len(seq) + 1):
            leaves[seq[:d]] += seq not in kids
            saved[seq[:d]] += (len(members) - 1) * len(seq[-1][1].encode()) if seq else 0
    return sorted(((min(m), len(s), min(nodes[s[:-1]][0]) if s else None, len(m), kids.get(s, 0), leaves[s], saved[s], sha(",".join(map(str, sorted(e))))) for s, (m, e) in nodes.items()), key=repr)


def rows(n: int, seed: int = 1, most: int = 12):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        turns = [(rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "c\n", ""])) for _ in range(rng.randint(1, most))]
        if c % 4 == 0:
            turns = [("user", "same")] * (c % 3 + 1) + turns[:2]
        out += [(c * 3 - 20, k, *t) for k, t in enumerate(turns)]
    long = [("user" if k % 2 else "assistant", f"t{k % 7}") for k in range(45)]
    out += [(c, k, *t) for c in (1001, 1003, 1006, 1011) for k, t in enumerate(long[: 45 - c % 2 * 9])]  # long ones that agree
    out += [(2000 + c, k, "user", "copy") for c in range(40) for k in range(9)]
    out += [(5001, None, None, None), (5001, 1, "user", None), (5001, 1, None, "tie"), (5001, 1, "user", "tie"), (5001, 1, "user", "tie"), (None, 1, "user", "nobody"), (5002, 2**40, "user", "x" * 300_000)]
    rng.shuffle(out)
    return out


def run(spark, data, **how):
    df = spark.createDataFrame(data, SCHEMA)
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    df = df.withColumns({"pos": F.lit("x"), "id": F.lit(1), "n": F.lit(2), "key": F.lit(3), "size": F.lit(None).cast("int")})
    made = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.encoded(df), head, F.col("conv_id") - F.col("conv_id") % 5, 8), **how)
    return sorted(map(tuple, made.select(COLUMNS).collect()), key=repr)


@pytest.mark.parametrize(("storey", "shard"), [(32, 4096), (4, 3), (7, 1)])
def test_equals_brute_force(spark, storey, shard):
    data = rows(60)
    assert run(spark, data, storey=storey, run=shard) == brute(data)


def test_no_rows_and_no_ids(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []


def test_turnless_conversation(spark):
    """One whose first turns are dropped and whose base does not exist."""
    c = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    data = [(c, 0, "user", "gone")]
    assert run(spark, data) == brute(data) == [(c, 0, None, 1, 0, 1, 0, sha(str(c)))]


def test_trees_are_balanced():
    seqs = [([i], [1], 1, i, 0, 0, 0) for i in range(1023)]
    tree = prefix_trie.balanced(seqs)

    def deepest(x):
        level, depth = [x], 0
        while level:
            level, depth = [y for z in level for y in (tree.low[z], tree.high[z]) if y >= 0], depth + 1
        return depth

    assert deepest(tree.down[0]) == 10
    assert tree.n[0] == 1023 and tree.conv[0] == 0


def test_sql_equals_brute_force():
    data = [r for r in rows(30) if r[0] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", data)
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP12})").fetchall(), key=repr) == brute(data)
