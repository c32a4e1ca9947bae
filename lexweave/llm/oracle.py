"""DuckDB SQL for the queries that SQL can express."""

MIX = r"""
WITH sized AS (
  SELECT doc_id, coalesce('+' || source, '-') AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         left(md5(coalesce(doc_id::VARCHAR, 'null')), 9) AS h
  FROM documents),
by_source AS (SELECT skey, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey),
placed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT] AS weight,
         source_size * 2.0::DOUBLE AS cap FROM by_source),
filled AS (
  SELECT *, coalesce(sum(cap) OVER w, 0) AS full_, coalesce(sum(weight) OVER w, 0) AS used,
         sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(weight) OVER () AS weights
  FROM placed WINDOW w AS (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT skey, source_size, least(weight * max((total - full_) / (weights - used)) OVER (), cap) AS target FROM filled),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM goals),
rests AS (SELECT *, CASE WHEN source_size > 0 THEN target - times * source_size ELSE 0 END AS rest FROM split),
leaves AS (SELECT skey, h, sum(size) AS sum_ FROM sized GROUP BY skey, h),
running AS (
  SELECT *, sum(sum_) OVER (PARTITION BY skey ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM leaves),
edges AS (
  SELECT r.skey, r.h AS cutoff, (s.rest - (r.upto - r.sum_)) * 2 >= r.sum_ AS inclusive
  FROM running r JOIN rests s USING (skey)
  WHERE s.rest > 0 AND r.upto - r.sum_ <= s.rest AND s.rest < r.upto)
SELECT d.doc_id, d.size, g.source_size, g.target,
       (d.size * (g.times + CASE WHEN d.h < e.cutoff OR (e.inclusive AND d.h = e.cutoff) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized d JOIN rests g USING (skey) LEFT JOIN edges e USING (skey)
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach(id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
least_ AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(l.component_id, e.vec_id) AS component_id,
       coalesce(e.vec_id = coalesce(l.component_id, e.vec_id), true) AS kept
FROM embeddings e LEFT JOIN least_ l ON l.id = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM pairs
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""

TRIE = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS place FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY place) AS own FROM t GROUP BY conv_id),
h AS (
  SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda b, i: xor(b >> 1, (b & 1) * 3988292384))), 4294967295) % 9 AS h FROM l),
s AS (
  SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS seq FROM h c LEFT JOIN l b ON b.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, len(seq) AS n, unnest(range(0, len(seq) + 1)) AS d, seq FROM s),
k AS (SELECT conv_id, n, d, seq[1:d] AS k FROM p),
nodes AS (
  SELECT d, k, min(conv_id) AS node, count(*) AS n_convs, coalesce(strlen(k[d].x), 0) AS bytes,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends FROM k GROUP BY d, k),
kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
up AS (SELECT m.*, coalesce(kids.n, 0) AS kids FROM nodes m LEFT JOIN kids ON kids.d = m.d AND kids.k = m.k),
above AS (SELECT a AS d, k[1:a] AS k, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((n_convs - 1) * bytes) AS saved
          FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM up) GROUP BY ALL)
SELECT u.node AS conv_id, u.d::BIGINT AS depth, o.node AS parent_conv_id, u.n_convs::BIGINT AS n_convs, u.kids::BIGINT AS n_children, a.leaves::BIGINT AS n_leaves,
       a.saved::BIGINT AS saved_tokens, sha256(u.ends) AS ends_sha256
FROM up u JOIN above a ON a.d = u.d AND a.k = u.k LEFT JOIN nodes o ON o.d = u.d - 1 AND o.k = u.k[1:u.d - 1] AND u.d > 0
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM pos JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3
"""


def jaccard(table: str, words: int, percent: int) -> str:
    """WITH clauses that end in joined(doc_id, n_shingles, component_id)."""
    return rf"""
w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM {table}),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < {words} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - {words - 2}), lambda i: array_to_string(ws[i:i + {words - 1}], ' '))) END AS sh FROM w),
o AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n - count(*) AS u, count(*) AS i FROM o a JOIN o b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
l AS (SELECT a, b FROM c WHERE 100 * i >= {percent} * u),
reach(id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.id, l.b FROM reach r JOIN l ON l.a = r.other),
joined AS (SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, (SELECT min(other) FROM reach r WHERE r.id = s.doc_id) AS component_id FROM s)"""


SQL = {
    "op1_embedding_neardup": NEAR_VECTORS,
    "op2_source_mix": MIX,
    "op4_cover_topk": TOP_K,
    "op11_prefix_trie": TRIE,
    "op13_hard_negatives": HARD_NEGATIVES,
    "op9_jaccard_join": f"WITH RECURSIVE {jaccard('documents', 3, 90)} SELECT * FROM joined",
}
