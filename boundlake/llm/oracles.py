"""SQL twins of the queries that SQL can express, each by a plainer way than the operator's."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""WITH w AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
b AS (SELECT item_id, {_ALNUM} AS ws FROM benchmark),
k AS (SELECT item_id, ws, least(10, len(ws)) AS k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM k),
sizes AS (SELECT DISTINCT k FROM g),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, sizes WHERE len(ws) >= k) AS q),
m AS (SELECT dw.doc_id, g.item_id, dw.i, dw.k FROM dw JOIN g ON dw.win = g.win AND dw.k = g.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) AS q GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) AS q GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h ON w.doc_id = h.doc_id LEFT JOIN it ON w.doc_id = it.doc_id"""

NEAR_DEDUP = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0) AS q) AS p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
r AS (SELECT x AS doc_id, x AS other FROM l UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other),
c AS (SELECT doc_id, min(other) AS component FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, w.doc_id) AS component_id, coalesce(c.component, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.doc_id"""

HARD_NEGATIVES = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e AS a JOIN e AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS k FROM s WHERE same) AS q WHERE k <= 5),
n AS (SELECT p.anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS k
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 3"""

PREFIX_TRIE = r"""WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT c, s, 0 AS k, CAST(4294967295 AS BIGINT) AS v FROM ids
  UNION ALL SELECT c, s, k + 1, CASE WHEN w & 1 = 1 THEN xor(w >> 1, CAST(3988292384 AS BIGINT)) ELSE w >> 1 END
  FROM (SELECT c, s, k, CASE WHEN k % 8 = 0 THEN xor(v, CAST(ascii(substr(s, k // 8 + 1, 1)) AS BIGINT)) ELSE v END AS w FROM bits WHERE k < 8 * length(s)) AS q),
h AS (SELECT c, c - c % 20 AS base, xor(v, CAST(4294967295 AS BIGINT)) % 4 AS h FROM bits WHERE k = 8 * length(s)),
t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
m AS (SELECT c, count(*) AS n FROM t GROUP BY 1),
r0 AS (SELECT h.c, t.p AS d, role, text FROM h JOIN t ON t.c = h.base AND t.p <= h.h
  UNION ALL SELECT h.c, t.p - h.h + least(h.h, coalesce(m.n, 0)), role, text FROM h JOIN t ON t.c = h.c AND t.p > h.h LEFT JOIN m ON m.c = h.base),
r AS (SELECT c, d, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d)) AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM r0
  UNION ALL SELECT c, 0, '', 0 FROM h),
v AS (SELECT key, d, min(c) AS rep, count(*) AS n, max(w) AS w FROM r GROUP BY 1, 2),
up AS (SELECT v.key, q.key AS above FROM v JOIN r AS q ON q.c = v.rep AND q.d = v.d - 1),
ch AS (SELECT above, count(*) AS n FROM up GROUP BY 1),
sub AS (SELECT r.key, sum(CASE WHEN ch.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((v.n - 1) * v.w) AS saved FROM v LEFT JOIN ch ON ch.above = v.key JOIN r ON r.c = v.rep AND r.d <= v.d GROUP BY 1),
e AS (SELECT key, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM (SELECT r.c, r.key FROM r JOIN (SELECT c, max(d) AS d FROM r GROUP BY 1) AS z ON r.c = z.c AND r.d = z.d) AS q GROUP BY 1)
SELECT v.rep AS conv_id, CAST(v.d AS BIGINT) AS depth, a.rep AS parent_conv_id, v.n AS n_convs, coalesce(ch.n, 0) AS n_children, CAST(sub.leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens,
  coalesce(e.ends, sha256('')) AS ends_sha256
FROM v JOIN sub ON sub.key = v.key LEFT JOIN up ON up.key = v.key LEFT JOIN v AS a ON a.key = up.above LEFT JOIN ch ON ch.above = v.key LEFT JOIN e ON e.key = v.key"""
