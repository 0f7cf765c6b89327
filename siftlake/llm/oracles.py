"""DuckDB SQL for the queries that SQL can express."""

FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

TOKENS = rf"regexp_extract_all({FOLD}, '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op8_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex FROM p),
c AS (SELECT hex, max(page_id) AS top, count(*) AS k FROM h GROUP BY hex),
b AS (SELECT hex, string_agg(CASE WHEN length(f) = 5 THEN substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum([CAST(f[i] AS INT) * CAST(pow(2, 5 - i) AS INT) FOR i IN range(1, 6)]) AS INT) + 1, 1) END, '' ORDER BY k) AS digest FROM
 (SELECT hex, k, substr(bits, 5 * k + 1, 5) AS f FROM (SELECT hex, string_agg(substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (position(substr(hex, i, 1) IN '0123456789abcdef') - 1) + 1, 4), '' ORDER BY i) AS bits FROM (SELECT DISTINCT hex, unnest(range(1, 41)) AS i FROM c) GROUP BY hex), (SELECT unnest(range(0, 32)) AS k)) GROUP BY hex)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
CASE WHEN k > 1 AND top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN k > 1 AND top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM h JOIN c USING (hex) JOIN b USING (hex)""",
    "op10_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, {TOKENS} AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
s AS MATERIALIZED (SELECT DISTINCT doc_id, x FROM g),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS MATERIALIZED (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
e AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
r(id, reach) AS (SELECT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id""",
    "op1_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {WORDS} AS w FROM benchmark),
g AS (SELECT item, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, list_slice(w, i, i + 12) AS x FROM g),
sizes AS (SELECT DISTINCT len(x) AS n FROM win),
p AS (SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
runs AS (SELECT rid, i, n, list_slice(w, i, i + n - 1) AS x FROM p),
hits AS (SELECT rid, i, n, item FROM runs JOIN win USING (x)),
words AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)""",
    "op6_preference": """
WITH t AS (SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS side, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
sides AS (SELECT pair_id, max(CASE WHEN side = 0 THEN i END) AS nc, max(CASE WHEN side = 1 THEN i END) AS nr FROM t GROUP BY pair_id),
same AS (SELECT a.pair_id, a.i FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.i = b.i AND a.side = 0 AND b.side = 1 AND a.role = b.role AND a.text = b.text),
runs AS (SELECT pair_id, count(*) AS n FROM (SELECT pair_id, i, row_number() OVER (PARTITION BY pair_id ORDER BY i) AS k FROM same) WHERE i = k GROUP BY pair_id),
r AS (SELECT t.*, coalesce(n, 0) AS n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS s FROM t LEFT JOIN runs USING (pair_id)),
p AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY pair_id, side, i > n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM r),
o AS (SELECT pair_id, max(n) AS n, string_agg(CASE WHEN side = 0 AND i <= n THEN s END, '' ORDER BY i) AS prompt,
 string_agg(CASE WHEN side = 0 AND i > n THEN s END, '' ORDER BY i) AS chosen, string_agg(CASE WHEN side = 1 AND i > n THEN s END, '' ORDER BY i) AS rejected,
 string_agg(CASE WHEN side = 0 AND i > n AND role = 'assistant' THEN CAST(CAST(pos AS BIGINT) + length(role) + 5 AS VARCHAR) || '-' || CAST(CAST(pos AS BIGINT) + length(role) + 12 + length(text) AS VARCHAR) END, ',' ORDER BY i) AS cm,
 string_agg(CASE WHEN side = 1 AND i > n AND role = 'assistant' THEN CAST(CAST(pos AS BIGINT) + length(role) + 5 AS VARCHAR) || '-' || CAST(CAST(pos AS BIGINT) + length(role) + 12 + length(text) AS VARCHAR) END, ',' ORDER BY i) AS rm FROM p GROUP BY pair_id)
SELECT o.pair_id, CAST(o.n AS BIGINT) AS n_prompt_turns, coalesce(prompt, '') AS prompt,
CASE WHEN nc IS NULL THEN NULL ELSE coalesce(chosen, '') END AS chosen, CASE WHEN nr IS NULL THEN NULL ELSE coalesce(rejected, '') END AS rejected,
CASE WHEN nc IS NULL THEN NULL ELSE coalesce(cm, '') END AS chosen_mask, CASE WHEN nr IS NULL THEN NULL ELSE coalesce(rm, '') END AS rejected_mask
FROM o JOIN sides USING (pair_id)""",
}
