"""DuckDB SQL for the operators that SQL can express, over whole tables; doc_ids are taken to be unique there."""

from __future__ import annotations

from .licenses import BASE, DRIFT, SHARE, TEMPLATES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _alnum(column: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


OP2 = f"""
WITH d AS (SELECT doc_id, {_alnum("text")} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_alnum("text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[j : j + least(10, len(w)) - 1], ' ') AS s FROM i, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(j) WHERE len(w) > 0),
dw AS (SELECT doc_id, j, n, array_to_string(w[j : j + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM iw) AS x(n), unnest(range(1, len(w) - n + 2)) AS t(j)),
hit AS (SELECT doc_id, j, dw.n, item_id FROM dw JOIN iw ON iw.n = dw.n AND iw.s = dw.s),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + n)) AS p FROM (SELECT DISTINCT doc_id, j, n FROM hit)) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id
"""


def _spans(length: int) -> str:
    """Disjoint spans (doc_id, a, b) out of the starts of removed windows in `late`(doc_id, j)."""
    return f"""spans AS (SELECT doc_id, min(j) AS a, max(j) + {length} AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY j) AS g FROM (SELECT *, CASE WHEN j - lag(j) OVER (PARTITION BY doc_id ORDER BY j) <= {length} THEN 0 ELSE 1 END AS new FROM late)) GROUP BY doc_id, g)"""


OP4 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, j, md5(array_to_string(w[j : j + 49], ' ')) AS s FROM d, unnest(range(1, len(w) - 48)) AS t(j)),
late AS (SELECT doc_id, j FROM win JOIN (SELECT s, min(doc_id) AS m FROM win GROUP BY s) f ON f.s = win.s WHERE doc_id > m),
{_spans(50)},
kept AS (SELECT x.doc_id, string_agg(x.v, ' ' ORDER BY x.p) AS s FROM (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS p FROM d) x WHERE NOT EXISTS (SELECT 1 FROM spans WHERE spans.doc_id = x.doc_id AND x.p >= a AND x.p < b) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, sum(b - a) AS n FROM spans GROUP BY 1) r ON r.doc_id = d.doc_id
"""

OP9 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS MATERIALIZED (SELECT doc_id, 500 * k AS j0, substr(h, 1000 * k + 1, 1198) AS hb FROM d, unnest(range(0, CAST(len(h) / 1000 AS BIGINT) + 1)) AS t(k)),
win AS MATERIALIZED (SELECT doc_id, j0 + i AS j, md5(substr(hb, 2 * i + 1, 200)) AS s FROM blocks, unnest(range(0, CAST(len(hb) / 2 AS BIGINT) - 99)) AS t(i)),
late AS (SELECT doc_id, j FROM (SELECT doc_id, j, row_number() OVER (PARTITION BY s ORDER BY doc_id, j) AS r FROM win) WHERE r > 1),
{_spans(100)},
cuts AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY b) AS z FROM (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, NULL, 0 FROM d)),
kept AS (SELECT c.doc_id, string_agg(substr(d.h, 2 * c.a + 1, 2 * (coalesce(c.z, CAST(len(d.h) / 2 AS BIGINT)) - c.a)), '' ORDER BY c.a) AS s FROM cuts c JOIN d ON d.doc_id = c.doc_id GROUP BY 1)
SELECT d.doc_id, CAST(len(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(k, 0) AS n_spans, sha256(unhex(coalesce(s, ''))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, sum(b - a) AS n, count(*) AS k FROM spans GROUP BY 1) r ON r.doc_id = d.doc_id
"""


def _phrases() -> str:
    """Places of the base phrases, each word compared where it stands."""
    parts = []
    for phrase, label in BASE:
        w = phrase.split()
        same = " AND ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(w))
        parts.append(f"SELECT doc_id, i, '{label}' AS label FROM d, unnest(range(0, len(w) - {len(w) - 1})) AS t(i) WHERE {same}")
    return " UNION ALL ".join(parts)


def _grams() -> str:
    rows = []
    for n, (phrase, label) in enumerate(TEMPLATES):
        w = phrase.split()
        rows += [f"({n}, '{label}', {len(w) - 1}, {i}, '{w[i]}', '{w[i + 1]}')" for i in range(len(w) - 1)]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(template, label, size, place, a, b)"


# The score is 1 where a base phrase stands, else the best share of a longer template.
OP10 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_alnum("text")} AS w FROM documents),
base AS MATERIALIZED ({_phrases()}),
g AS ({_grams()}),
pairs AS (SELECT doc_id, i, w[i + 1] AS a, w[i + 2] AS b FROM d, unnest(range(0, len(w) - 1)) AS t(i)),
votes AS MATERIALIZED (SELECT doc_id, template, label, size, i - place AS diagonal, place FROM pairs JOIN g ON g.a = pairs.a AND g.b = pairs.b),
spans AS MATERIALIZED (SELECT DISTINCT v.doc_id, v.template, v.label, v.size, d.diagonal, v.diagonal + v.place AS i, v.place FROM (SELECT DISTINCT doc_id, template, diagonal FROM votes) d JOIN votes v ON v.doc_id = d.doc_id AND v.template = d.template AND v.diagonal BETWEEN d.diagonal AND d.diagonal + {DRIFT}),
rising(doc_id, template, diagonal, i, place, n) AS (SELECT doc_id, template, diagonal, i, place, 1 FROM spans UNION SELECT r.doc_id, r.template, r.diagonal, s.i, s.place, r.n + 1 FROM rising r JOIN spans s ON s.doc_id = r.doc_id AND s.template = r.template AND s.diagonal = r.diagonal AND s.i > r.i AND s.place > r.place),
parts AS (SELECT s.doc_id, s.label, r.n / CAST(s.size AS DOUBLE) AS part FROM (SELECT doc_id, template, diagonal, max(n) AS n FROM rising GROUP BY 1, 2, 3) r JOIN (SELECT DISTINCT doc_id, template, diagonal, label, size FROM spans) s ON s.doc_id = r.doc_id AND s.template = r.template AND s.diagonal = r.diagonal),
names AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM parts WHERE part >= {SHARE}) GROUP BY 1),
places AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY 1),
best AS (SELECT doc_id, max(part) AS part FROM parts GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(part, 0.0) END AS score
FROM d LEFT JOIN places ON places.doc_id = d.doc_id LEFT JOIN names ON names.doc_id = d.doc_id LEFT JOIN best ON best.doc_id = d.doc_id
"""


def _field(column: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({column} AS VARCHAR))) AS VARCHAR) || ':' || CAST({column} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _crc32(column: str) -> str:
    """CRC-32 (IEEE) of an integer's decimal digits, bit by bit: DuckDB has no such function."""
    digits = f"list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda ch: ascii(ch))"
    bit = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END"
    byte = f"list_reduce(range(8), lambda a, b: {bit}, xor(c, CAST(x AS BIGINT)))"
    return f"xor(list_reduce({digits}, lambda c, x: {byte}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


# Trees level by level; a leaf's fold and the siblings it meets go up its language's tree (part 0), then the top one (part 1).
OP11 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, CASE WHEN {_crc32("doc_id")} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS other FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
groups AS MATERIALIZED (SELECT lang, n, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT lang, count(*) AS n FROM d GROUP BY 1)),
low(g, level, i, h, n) AS (SELECT g, 0, i, leaf, groups.n FROM placed JOIN groups ON placed.lang IS NOT DISTINCT FROM groups.lang
  UNION ALL SELECT g, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), CAST(ceil(max(n) / 2.0) AS BIGINT) FROM low WHERE n > 1 GROUP BY g, level, i // 2),
lows AS MATERIALIZED (SELECT * FROM low),
subroots AS MATERIALIZED (SELECT g, h FROM lows WHERE n = 1),
high(level, i, h, n) AS (SELECT 0, g, h, count(*) OVER () FROM subroots
  UNION ALL SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), CAST(ceil(max(n) / 2.0) AS BIGINT) FROM high WHERE n > 1 GROUP BY level, i // 2),
highs AS MATERIALIZED (SELECT * FROM high),
depth AS MATERIALIZED (SELECT g, max(level) AS m FROM lows GROUP BY 1),
nodes AS MATERIALIZED (SELECT g, level, i, h FROM lows WHERE n > 1 UNION ALL SELECT depth.g, depth.m + highs.level, highs.i, highs.h FROM depth, highs WHERE highs.n > 1),
walk(r, g, level, i, h, proof) AS (SELECT row_number() OVER (ORDER BY g, placed.i), g, 0, placed.i, other, '' FROM placed JOIN groups ON placed.lang IS NOT DISTINCT FROM groups.lang
  UNION ALL SELECT w.r, w.g, w.level + 1, CASE WHEN w.level + 1 = m THEN w.g ELSE w.i // 2 END, sha256(CASE WHEN w.i % 2 = 1 THEN coalesce(s.h, '') || w.h ELSE w.h || coalesce(s.h, '') END), proof || coalesce(s.h, '')
  FROM (SELECT w.r, w.g, w.level, CASE WHEN w.level = m THEN w.g ELSE w.i END AS i, w.h, w.proof, m FROM walk w JOIN depth USING (g)) w JOIN nodes own ON own.g = w.g AND own.level = w.level AND own.i = w.i LEFT JOIN nodes s ON s.g = w.g AND s.level = w.level AND s.i = xor(w.i, 1)),
ends AS (SELECT r, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM walk GROUP BY 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, e.h AS folded_root, e.h = t.h AS verified
FROM (SELECT placed.*, g, row_number() OVER (ORDER BY g, i) AS r FROM placed JOIN groups ON placed.lang IS NOT DISTINCT FROM groups.lang) p JOIN ends e ON e.r = p.r JOIN subroots s ON s.g = p.g, (SELECT h FROM highs WHERE n = 1) t
"""


# A node is named by the digest of its turns' digests; every node counts for all of its prefixes.
OP12 = f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, code) AS pos, code, size FROM (SELECT conv_id, turn, sha256(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS code, octet_length(encode(coalesce(text, ''))) AS size FROM conversations WHERE conv_id IS NOT NULL)),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32("conv_id")} % 9 AS h, count(*) AS n FROM t GROUP BY conv_id),
m AS MATERIALIZED (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS m, c.n FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS MATERIALIZED (SELECT m.conv_id, t.pos, t.code, t.size FROM m JOIN t ON t.conv_id = m.base AND t.pos <= m.m UNION ALL SELECT m.conv_id, t.pos - m.h + m.m, t.code, t.size FROM m JOIN t ON t.conv_id = m.conv_id AND t.pos > m.h),
p(conv_id, depth, key, up, size) AS (SELECT conv_id, CAST(0 AS BIGINT), sha256(''), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT) FROM m UNION ALL SELECT p.conv_id, p.depth + 1, sha256(p.key || r.code), p.key, r.size FROM p JOIN r ON r.conv_id = p.conv_id AND r.pos = p.depth + 1),
walks AS MATERIALIZED (SELECT * FROM p),
node AS MATERIALIZED (SELECT key, up, depth, max(size) AS size, count(*) AS n, min(conv_id) AS conv FROM walks GROUP BY 1, 2, 3),
kids AS MATERIALIZED (SELECT up AS key, count(*) AS k FROM node WHERE up IS NOT NULL GROUP BY 1),
own AS MATERIALIZED (SELECT node.key, CASE WHEN k IS NULL THEN 1 ELSE 0 END AS leaf, (n - 1) * size AS saved FROM node LEFT JOIN kids ON kids.key = node.key),
above(key, anc) AS (SELECT key, key FROM node UNION ALL SELECT above.key, node.up FROM above JOIN node ON node.key = above.anc WHERE node.up IS NOT NULL),
sums AS MATERIALIZED (SELECT anc, sum(leaf) AS leaves, sum(saved) AS saved FROM above JOIN own ON own.key = above.key GROUP BY 1),
lens AS (SELECT conv_id, max(depth) AS len FROM walks GROUP BY 1),
ends AS (SELECT key, string_agg(CAST(walks.conv_id AS VARCHAR), ',' ORDER BY walks.conv_id) AS ids FROM walks JOIN lens ON lens.conv_id = walks.conv_id AND walks.depth = len GROUP BY 1)
SELECT node.conv AS conv_id, node.depth, u.conv AS parent_conv_id, node.n AS n_convs, CAST(coalesce(k, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node LEFT JOIN node u ON u.key = node.up LEFT JOIN kids ON kids.key = node.key JOIN sums ON sums.anc = node.key LEFT JOIN ends ON ends.key = node.key
"""


# All pairs that share a shingle are counted; labels then go to neighbours until each has its least.
OP13 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[j : j + 2], ' ') END AS s FROM d, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS t(j) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
sides AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT DISTINCT a, a FROM sides UNION SELECT reach.a, sides.b FROM reach JOIN sides ON sides.a = reach.b),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id
"""
