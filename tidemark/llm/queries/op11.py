from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm.registry import query
from tidemark.llm.trie import RECORD, paths, prefix_trie

# crc32 of a decimal number, byte by byte; the table follows from the polynomial.
SQL = """
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, xor(4294967295, list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda c, b: xor(c >> 8, crc.t[xor(c & 255, b) + 1]), CAST(4294967295 AS BIGINT))) % 9 AS h FROM ids, crc),
t AS (SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS size, md5(concat(octet_length(encode(coalesce(role, ''))), ':', role, text)) AS id FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id, size) AS k FROM t),
r AS (SELECT h.conv_id, o.k, o.id, o.size FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 5 AND o.k <= h.h UNION ALL
  SELECT h.conv_id, h.h + row_number() OVER (PARTITION BY h.conv_id ORDER BY o.k), o.id, o.size FROM h JOIN o ON o.conv_id = h.conv_id AND o.k > h.h),
s AS (SELECT conv_id, id, size, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d FROM r),
p AS (SELECT conv_id, CAST(0 AS BIGINT) AS d, '' AS node, CAST(NULL AS VARCHAR) AS up, CAST(0 AS BIGINT) AS size FROM ids UNION ALL
  SELECT s.conv_id, s.d, md5(p.node || s.id || s.size), p.node, s.size FROM p JOIN s ON s.conv_id = p.conv_id AND s.d = p.d + 1),
n AS (SELECT node, any_value(up) AS up, any_value(size) AS size, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY node, d),
e AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT * FROM p QUALIFY d = max(d) OVER (PARTITION BY conv_id)) GROUP BY node),
c AS (SELECT up AS node, count(*) AS n FROM n WHERE up IS NOT NULL GROUP BY 1),
a AS (SELECT node AS top, node FROM n UNION ALL SELECT n.up, a.node FROM a JOIN n ON n.node = a.top WHERE n.up IS NOT NULL),
w AS (SELECT a.top AS node, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved FROM a JOIN n USING (node) LEFT JOIN c USING (node) GROUP BY 1)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, w.n_leaves, CAST(w.saved AS BIGINT) AS saved_tokens,
  coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN w ON w.node = n.node LEFT JOIN n u ON u.node = n.up LEFT JOIN e ON e.node = n.node LEFT JOIN c ON c.node = n.node
"""

SHARED = 8  # turns that a conversation can take over at most


def rebuilt(conversations):
    """(conv_id, path): the first h turns of conversation c - c % 5, then c's own turns after its first h."""
    own = paths(conversations).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1) * RECORD)
    own = own.withColumn("base", F.expr("conv_id - conv_id % 5"))
    lent = own.filter("conv_id = base").select("base", F.expr(f"substring(path, 1, {SHARED * RECORD})").alias("lent"))
    begin = F.coalesce(F.expr("substring(lent, 1, cast(h as int))"), F.unhex(F.lit("")))
    return own.join(lent, "base", "left").select("conv_id", F.concat(begin, F.expr("substring(path, cast(h as int) + 1)")).alias("path"))


@query("op11_burst_trie", SQL)
def op11(spark, folder):
    return prefix_trie(rebuilt(spark.read.parquet(f"{folder}/conversations.parquet")))
