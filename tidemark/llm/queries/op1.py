from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm.common import UNIFORM_SQL, documents
from tidemark.llm.mixing import mix
from tidemark.llm.registry import query

SQL = f"""
WITH s AS (SELECT coalesce('=' || source, '-') AS key, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY 1),
t AS (SELECT sum(size) AS size, sum(pow(size, 0.5)) AS weight FROM s),
r AS (SELECT s.key, CASE WHEN s.size > 0 THEN t.size * (pow(s.size, 0.5) / t.weight) / s.size ELSE 0 END AS rate FROM s, t),
k AS (SELECT key, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS k FROM r WHERE rate > 0),
p AS (SELECT key, k, CASE WHEN k = 0 THEN exp(-rate) ELSE exp(k * ln(rate) - rate - lgamma(k + 1)) END AS p FROM k),
c AS (SELECT key, k, sum(p) OVER (PARTITION BY key ORDER BY k) AS upto FROM p),
d AS (SELECT doc_id, source, text, coalesce('=' || source, '-') AS key, {UNIFORM_SQL.format("'1', CAST(doc_id AS VARCHAR)")} AS u FROM documents),
n AS (SELECT d.doc_id, d.source, d.text, c.k AS copy FROM d JOIN c ON c.key = d.key AND c.upto <= d.u)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, md5(concat_ws('|', '1o', CAST(doc_id AS VARCHAR), CAST(copy AS VARCHAR))) AS shuffle_key,
  CAST(length(text) AS BIGINT) AS text_length, md5(text) AS text_md5 FROM n
"""


@query("op1_poisson_mix", SQL)
def op1(spark, folder):
    """Half-way between the sources' own sizes and equal shares."""
    return mix(documents(spark, folder), exponent=0.5, epochs=1.0, seed=1).select(
        "doc_id", "source", "copy", "shuffle_key", F.length("text").cast("long").alias("text_length"), F.md5("text").alias("text_md5"))
