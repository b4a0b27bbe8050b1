from __future__ import annotations

from tidemark.llm.common import documents
from tidemark.llm.dedup import near_duplicates
from tidemark.llm.registry import query

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Pairs that share one of their rarest fifth of shingles are the only ones that can reach four fifths.
SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
f AS (SELECT x, count(*) AS f FROM e GROUP BY x),
p AS (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY f, x) AS k FROM e JOIN f USING (x)),
r AS (SELECT doc_id, n, x FROM p WHERE k <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.x = b.x AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)),
i AS (SELECT c.a, c.b, len(sa.s) AS na, len(sb.s) AS nb, len(list_intersect(sa.s, sb.s)) AS m FROM c JOIN s sa ON sa.doc_id = c.a JOIN s sb ON sb.doc_id = c.b),
l AS (SELECT a, b FROM i WHERE 100 * m >= 80 * (na + nb - m)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT t.a, u.b FROM t JOIN u ON t.b = u.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM t GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept FROM s JOIN m USING (doc_id)
"""


@query("op8_chosen_path_join", SQL)
def op8(spark, folder):
    return near_duplicates(documents(spark, folder), width=2, similarity=0.8)
