import collections
import hashlib
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing as M
from tidemark.llm.queries import op1

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key int, copy string"


def uniform(seed, i):
    return int(hashlib.md5((f"{seed}|{i}" if i is not None else f"{seed}").encode()).hexdigest()[:13], 16) / 2**52


def poisson(rate, u):
    """Smallest k whose cumulative probability is above u."""
    if rate == 0:
        return 0
    k, total = 0, math.exp(-rate)
    while total <= u:
        k += 1
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    return k


def rows():
    out = [(i, "ab " * (i % 7 + 1), "en", ["big", "big", "big", "small", None][i % 5], 3, 1, "x") for i in range(400)]
    return out + [(900, None, "en", "big", None, 1, "x"), (901, "", "en", "hollow", 0, 1, "x"), (None, "abc", None, "small", 3, 1, "x"), (3, "ab " * 4, "en", "small", 3, 1, "x")]


@pytest.mark.parametrize("weights, few", [(None, 10_000), ({"big": 1.0, "small": 3.0, None: 1.0}, 10_000), ({"small": 50.0}, 0)])
def test_copies_equal_inverted_poisson(spark, monkeypatch, weights, few):
    monkeypatch.setattr(M, "BROADCAST_SOURCES", few)
    data = rows()
    size = collections.Counter()
    for r in data:
        size[r[3]] += len(r[1] or "")
    total = sum(size.values())
    w = {s: size[s] ** 0.5 if weights is None else weights.get(s, 0.0) for s in size}
    rate = {s: 2.0 * total * w[s] / sum(w.values()) / size[s] if size[s] else 0.0 for s in size}
    want = collections.Counter()
    for r in data:
        want[r[0], r[3]] += poisson(rate[r[3]], uniform(5, r[0]))
    out = M.mix(spark.createDataFrame(data, SCHEMA).repartition(3), weights, epochs=2.0, seed=5).collect()
    got = collections.Counter((r["doc_id"], r["source"]) for r in out)
    assert got == +want
    assert all({r["copy"] for r in out if r["doc_id"] == i} == set(range(max(r["copy"] for r in out if r["doc_id"] == i) + 1)) for i in (0, 1, 4, None) if any(r["doc_id"] == i for r in out))


def test_large_rates_keep_their_mean(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    n = M.mix(df, epochs=900.0).count()
    assert abs(n / 300 - 900) < 6


def test_sql_and_spark_agree(spark, folder):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    cols = "doc_id, source, copy, shuffle_key, text_length, text_md5"
    want = sorted(con.execute(f"select {cols} from ({op1.SQL})").fetchall(), key=repr)
    got = sorted((tuple(r) for r in op1.op1(spark, folder).select(*cols.split(", ")).collect()), key=repr)
    assert got == want


def test_empty_table(spark):
    assert M.mix(spark.createDataFrame([], SCHEMA)).count() == 0
