"""The corpus queries that SQL can express, for DuckDB."""

from __future__ import annotations

from .neardup import SHINGLE
from .suffix_dedup import WINDOW as BYTES
from .fm_dedup import WINDOW as WORDS

#: Runs of windows that begin at most a window apart are one removed run; what stands between runs is kept.
_RUNS = """
runs AS (
  SELECT doc_id, min(pos) AS a, max(pos) + {window} AS z FROM (
    SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (
      SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= {window} THEN 0 ELSE 1 END AS fresh FROM hits))
  GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM runs
  UNION ALL
  SELECT d.doc_id, coalesce(max(r.z), 0), max(d.n) FROM d LEFT JOIN runs r USING (doc_id) GROUP BY d.doc_id),
gone AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)"""

# long texts are cut into overlapping pieces first, so that no window is searched for from a text's start
_BYTES = f"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
pieces AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2 * (1000 + {BYTES - 1})) AS h FROM (SELECT doc_id, h, unnest(range(0, n, 1000)) AS p FROM d)),
windows AS (
  SELECT doc_id, p + i AS pos, substr(h, 2 * i + 1, {2 * BYTES}) AS s
  FROM (SELECT doc_id, p, h, unnest(range(0, least(1000, length(h) // 2 - {BYTES - 1}))) AS i FROM pieces)),
first AS (SELECT s, min(doc_id) AS doc_id FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT w.doc_id, w.pos FROM windows w JOIN first f ON w.s = f.s AND f.doc_id < w.doc_id),
{_RUNS.format(window=BYTES)},
kept AS (SELECT g.doc_id, string_agg(substr(d.h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS h FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(from_hex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)"""

_SPLIT = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_WORDS = f"""
WITH d AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_SPLIT} AS w FROM documents)),
windows AS (
  SELECT doc_id, i AS pos, array_to_string(w[i + 1 : i + {WORDS}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(0, n - {WORDS - 1})) AS i FROM d)),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS k FROM windows),
hits AS (SELECT doc_id, pos FROM ranked WHERE k > 1),
{_RUNS.format(window=WORDS)},
kept AS (SELECT g.doc_id, array_to_string(flatten(list(d.w[x + 1 : y] ORDER BY x)), ' ') AS t FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)"""

# multisets of shingles as sets of (shingle, occurrence); documents that share all words are compared once
_NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, w, array_to_string(w, ' ') AS node FROM (SELECT doc_id, {_SPLIT} AS w FROM documents)),
nodes AS (SELECT node, any_value(w) AS w FROM d GROUP BY node),
shingles AS (
  SELECT node, array_to_string(w[i + 1 : i + {SHINGLE}], ' ') AS s
  FROM (SELECT node, w, unnest(range(0, greatest(len(w) - {SHINGLE - 1}, least(len(w), 1)))) AS i FROM nodes)),
bags AS (SELECT node, s, row_number() OVER (PARTITION BY node, s) AS nth FROM shingles),
sizes AS (SELECT node, count(*) AS n FROM bags GROUP BY node),
common AS (SELECT a.node AS a, b.node AS b, count(*) AS c FROM bags a JOIN bags b ON a.s = b.s AND a.nth = b.nth AND a.node < b.node GROUP BY a.node, b.node),
links AS (SELECT a, b FROM common JOIN sizes x ON x.node = a JOIN sizes y ON y.node = b WHERE c >= 0.8 * (x.n + y.n - c)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT node, node FROM nodes UNION SELECT r.a, s.b FROM reach r JOIN steps s ON s.a = r.b),
least AS (SELECT r.a AS node, min(d.doc_id) AS class_id FROM reach r JOIN d ON d.node = r.b GROUP BY r.a)
SELECT d.doc_id, least.class_id FROM d JOIN least USING (node)"""

#: One tree's levels, from nodes {0}_0 (g, i, n, h), and its runs.
_TREE = """
{0} AS (
  SELECT g, 0 AS level, i, n, h FROM {0}_0
  UNION ALL
  SELECT g, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM {0} WHERE n > 1 GROUP BY g, level, i // 8, n),
{0}_runs AS (SELECT g, level, i // 8 AS p, list(h ORDER BY i) AS run FROM {0} WHERE n > 1 GROUP BY g, level, i // 8)"""
_TAG = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_TAG.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"

# crc32 goes byte by byte through its table of 256 remainders
_MERKLE = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(0, 256) r(i)),
low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low_text FROM documents),
d AS (
  SELECT doc_id, lang AS g, {_LEAF.format("text")} AS h, {_LEAF.format("low_text")} AS low_h,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS crc
  FROM documents JOIN low USING (doc_id), crc),
below_0 AS (SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, h FROM d),
{_TREE.format("below")},
above_0 AS (SELECT g AS lang, '' AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM below WHERE n = 1),
{_TREE.format("above")},
steps AS (
  SELECT doc_id, 0 AS part, level, run, (i >> (3 * level)) % 8 AS place FROM below_0 b JOIN below_runs r ON r.g IS NOT DISTINCT FROM b.g AND r.p = b.i >> (3 * level + 3)
  UNION ALL
  SELECT doc_id, 1, level, run, (a.i >> (3 * level)) % 8 FROM d JOIN above_0 a ON a.lang IS NOT DISTINCT FROM d.g JOIN above_runs r ON r.p = a.i >> (3 * level + 3)),
halves AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, level) AS step, array_to_string(run[1 : place], '') AS l, array_to_string(run[place + 2 :], '') AS r FROM steps),
folds AS (
  SELECT doc_id, 0::BIGINT AS step, CASE WHEN crc % 3 = 0 THEN low_h ELSE h END AS h FROM d
  UNION ALL
  SELECT f.doc_id, f.step + 1, sha256(l || f.h || r) FROM folds f JOIN halves s ON s.doc_id = f.doc_id AND s.step = f.step + 1),
folded AS (SELECT doc_id, max_by(h, step) AS h FROM folds GROUP BY doc_id),
proofs AS (SELECT doc_id, string_agg(l || r, '' ORDER BY step) AS p FROM halves GROUP BY doc_id),
top AS (SELECT h FROM above WHERE n = 1)
SELECT d.doc_id, d.h AS leaf, a.h AS subroot, top.h AS root, sha256(coalesce(p.p, '')) AS proof_sha256, f.h AS folded_root, f.h = top.h AS verified
FROM d JOIN above_0 a ON a.lang IS NOT DISTINCT FROM d.g JOIN folded f USING (doc_id) LEFT JOIN proofs p USING (doc_id), top"""

ORACLES: dict[str, str] = {"op4_bagminhash_neardup": _NEAR, "op5_suffix_dedup": _BYTES, "op7_fm_dedup": _WORDS, "op11_merkle_manifest": _MERKLE}
