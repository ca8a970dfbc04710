"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quern.llm.bpe import op3_bpe
from quern.llm.minhash import op8_minhash
from quern.llm.mixing import op1_mixing
from quern.llm.quality import op10_quality
from quern.llm.quotes import op5_chat_format
from quern.llm.secrets import op6_secrets
from quern.llm.substring_dedup import op2_substring_dedup
from quern.llm.token_counts import op7_token_counts
from quern.llm.topk import op4_topk
from quern.llm.vector_dedup import op9_vector_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_substring_dedup, op3_bpe, op4_topk, op5_chat_format,
        op6_secrets, op7_token_counts, op8_minhash, op9_vector_dedup, op10_quality,
    )
}

#: DuckDB.  The others have no SQL: hypergeometric draws, tokenizers, decoded key structures and a trained model.  They are
#: tested by brute force, and so are op2 and op8, whose SQL takes every window or pair of equal shingles and suits small tables.
ORACLE_SQL = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
v AS (SELECT doc_id, u.p, array_to_string(w[u.p:u.p + 49], ' ') AS s FROM d, unnest(range(1, len(w) - 48)) AS u(p)),
g AS (SELECT s, min(doc_id) AS lo FROM v GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT v.doc_id, v.p + k.k AS i FROM v JOIN g USING (s), range(50) AS k(k) WHERE g.lo < v.doc_id),
x AS (SELECT doc_id, u.i, w[u.i] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
y AS (SELECT x.doc_id, count(*) AS n, count(c.i) AS gone, string_agg(x.word, ' ' ORDER BY x.i) FILTER (WHERE c.i IS NULL) AS kept
      FROM x LEFT JOIN c USING (doc_id, i) GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN y USING (doc_id)""",
    "op5_chat_format": r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, translate(coalesce(text, ''), chr(1) || chr(2), '  ') AS t FROM conversations),
a AS (SELECT rid, conv_id, turn, unnest(regexp_split_to_array(t, '\r\n|\n|\r')) AS s, generate_subscripts(regexp_split_to_array(t, '\r\n|\n|\r'), 1) AS i FROM m),
b AS (SELECT rid, conv_id, turn, i, length(regexp_replace(regexp_extract(s, '^((?:[ \t]?>)*)', 1), '[^>]', '', 'g')) AS lv,
             trim(regexp_replace(s, '^(?:[ \t]?>)*', ''), ' ') AS c FROM a),
e AS (SELECT *, lead(lv) OVER (PARTITION BY rid ORDER BY i) > lv AND regexp_matches(c, '(?i)(wrote|schrieb|a écrit|escribió)\s*:$') AS named,
             lead(lv) OVER (PARTITION BY rid ORDER BY i) AS next FROM b),
f AS (SELECT rid, conv_id, turn, i, CASE WHEN named THEN next ELSE lv END AS lv, CASE WHEN named THEN '' ELSE c END AS c FROM e),
body AS (SELECT rid, trim(string_agg(c, chr(10) ORDER BY i) FILTER (WHERE lv = 0), chr(10) || ' ') AS body FROM f GROUP BY rid),
h AS (SELECT *, c <> '' AND NOT coalesce(lag(lv) OVER w = lv AND lag(c) OVER w <> '', false) AS leads FROM f WINDOW w AS (PARTITION BY rid ORDER BY i)),
j AS (SELECT *, sum(leads::INT) OVER (PARTITION BY rid ORDER BY i) AS nth FROM h),
p AS (SELECT DISTINCT conv_id, turn, lv AS level, lower(regexp_replace(trim(words, ' '), '\s+', ' ', 'g')) AS said
      FROM (SELECT rid, conv_id, turn, nth, lv, string_agg(c, ' ' ORDER BY i) AS words FROM j WHERE c <> '' GROUP BY ALL)
      WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
here AS (SELECT said, conv_id, min(turn) AS o FROM p WHERE level = 0 GROUP BY ALL),
anywhere AS (SELECT said, min(conv_id) AS w_conv, arg_min(turn, (conv_id, turn)) AS w_turn FROM p WHERE level = 0 GROUP BY said),
l AS (SELECT p.conv_id, p.turn, p.level,
             CASE WHEN here.o < p.turn THEN p.conv_id WHEN w_conv < p.conv_id THEN w_conv END AS o_conv,
             CASE WHEN here.o < p.turn THEN here.o WHEN w_conv < p.conv_id THEN w_turn END AS o_turn
      FROM p LEFT JOIN here ON here.said = p.said AND here.conv_id = p.conv_id LEFT JOIN anywhere ON anywhere.said = p.said WHERE p.level > 0),
k AS (SELECT conv_id, turn, count(*) AS n_quoted, count(o_conv) AS n_linked FROM l GROUP BY ALL),
q AS (SELECT conv_id, turn, o_conv, o_turn FROM l WHERE o_conv IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, o_conv DESC, o_turn DESC) = 1),
n AS (SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
r AS (SELECT n.conv_id, n.turn, coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked,
             CASE WHEN q.o_conv IS NOT NULL THEN q.o_conv WHEN z.turn IS NOT NULL THEN n.conv_id END AS p_conv, coalesce(q.o_turn, z.turn) AS p_turn
      FROM n LEFT JOIN k USING (conv_id, turn) LEFT JOIN q USING (conv_id, turn) LEFT JOIN n z ON z.conv_id = n.conv_id AND z.turn + 1 = n.turn),
t(conv_id, turn, thread_conv, thread_turn, depth) AS (
  SELECT conv_id, turn, conv_id, turn, 0::BIGINT FROM r WHERE p_conv IS NULL
  UNION ALL SELECT r.conv_id, r.turn, t.thread_conv, t.thread_turn, t.depth + 1 FROM t JOIN r ON r.p_conv = t.conv_id AND r.p_turn = t.turn)
SELECT m.conv_id, m.turn, m.role, coalesce(body.body, '') AS body, coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked,
       p_conv AS parent_conv, p_turn AS parent_turn, thread_conv, thread_turn, coalesce(depth, 0) AS depth
FROM m LEFT JOIN body USING (rid) LEFT JOIN r USING (conv_id, turn) LEFT JOIN t USING (conv_id, turn)""",
    "op8_minhash": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[u.p:u.p + 4], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op4_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_vector_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
      WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.95),
r(vec_id, other) AS (SELECT vec_id, vec_id FROM u UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(k.n_links, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN k USING (vec_id) LEFT JOIN c USING (vec_id)""",
}
