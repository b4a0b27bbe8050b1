from __future__ import annotations

from tidemark.llm.common import documents
from tidemark.llm.registry import query
from tidemark.llm.spelling import variant_groups, word_counts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS i, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT i, w, count(*) AS n FROM r GROUP BY i, w),
b AS (SELECT i, w, n, hex(encode(i || ':' || w)) AS x FROM d),
h AS (SELECT w, n, xor(4294967295, list_reduce(list_transform(range(1, length(x), 2), lambda k: CAST('0x' || substr(x, k, 2) AS BIGINT)),
  lambda c, y: xor(c >> 8, crc.t[xor(c & 255, y) + 1]), CAST(4294967295 AS BIGINT))) AS h FROM b, crc),
e AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) + 2 AS BIGINT)) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
k AS MATERIALIZED (SELECT word, n, substr(word, 1, i) AS p, substr(word, i + 2) AS s FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n FROM k a JOIN k b ON a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION SELECT k.word, v.word, v.n FROM k JOIN v ON v.word = k.p || k.s UNION SELECT v.word, k.word, k.n FROM k JOIN v ON v.word = k.p || k.s),
m AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form, CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n FROM v LEFT JOIN m USING (word)),
c AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, c.root FROM c JOIN f ON f.form = c.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c USING (word)
"""


@query("op13_trie_pair_dictionary", SQL)
def op13(spark, folder):
    return variant_groups(word_counts(documents(spark, folder)))
