import collections
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import neighbours as N
from tidemark.llm.queries import op12


def brute(rows, k, asks):
    """Every pair of rows, sums from left to right."""
    use = [(i, np.array(v, "float64")) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    norm = [np.sqrt(np.cumsum(v * v)[-1]) for _, v in use]
    out = collections.Counter()
    for a, (i, v) in enumerate(use):
        if asks(i):
            found = sorted((-(np.cumsum(v * w)[-1] / (norm[a] * norm[b])), j) for b, (j, w) in enumerate(use) if b != a and len(v) == len(w))
            out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k]))
    return out


def corpus(seed, n, dims):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(size=dims).astype("float32").tolist()) for i in rng.permutation(4 * n)[:n]]
    rows += [(5000 + i, rows[3][1]) for i in range(40)]  # a very common vector
    rows += [(6000 + i, (np.array(rows[5][1], "float32") + np.float32(1e-4) * rng.normal(size=dims).astype("float32")).tolist()) for i in range(60)]  # a dense group
    rows += [(7000, [2 * x for x in rows[7][1]]), (7001, [-x for x in rows[7][1]]), (7002, [0.0] * dims), (7003, None), (7004, []), (7005, [None] + [1.0] * (dims - 1)),
             (7006, [float("nan")] + [1.0] * (dims - 1)), (7007, [float("inf")] + [1.0] * (dims - 1)), (None, rows[0][1]), (7010, [1.0, 2.0]), (7020, [2.0, 1.0]), (7020, [2.0, 1.0]), rows[1], rows[1]]
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize("kind, block, tile", [("float", 8192, 1024), ("double", 70, 16)])
def test_neighbours_equal_brute_force(spark, monkeypatch, kind, block, tile):
    monkeypatch.setattr(N, "LEAST_BLOCK", block)
    monkeypatch.setattr(N, "TILE", tile)
    if block < 100:
        monkeypatch.setattr(N, "QUERY_BYTES", 30 * 12 * 8)  # several query blocks
    rows = corpus(5, 300, 12)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id bigint, embedding array<{kind}>, rank int, Vec_Id string").repartition(4)
    got = collections.Counter(tuple(r) for r in N.nearest(df, F.col("vec_id") % 10 == 0, 5).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows, 5, lambda i: i % 10 == 0)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    a, b = (N.Block(rng.normal(size=(50, 1500)).astype("float32")) for _ in range(2))
    near = a.products(slice(0, 50), b, slice(0, 50)) * a.scale[:, None] * b.scale
    i, j = (x.reshape(-1) for x in np.indices((50, 50)))
    exact = a.cosines(i, b, j).reshape(50, 50)
    assert (np.abs(near - exact) <= b.error + a.error[:, None] * (1 + b.error) + N.SLACK).all()


def test_extreme_lengths(spark):
    rows = [(0, [1e-300, 2e-300]), (1, [1e300, 2e300]), (2, [2e300, -1e300])]
    out = N.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0, 5).collect()
    assert [(r["rank"], r["vec_id"]) for r in out] == [(1, 1), (2, 2)] and abs(out[0]["score"] - 1) < 1e-12 and abs(out[1]["score"]) < 1e-12


def test_sql_and_spark_agree(spark, folder):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    cols = "query_id, rank, vec_id, score"
    got = sorted(tuple(r) for r in op12.op12(spark, folder).select(*cols.split(", ")).collect())
    assert got == sorted(con.execute(f"select {cols} from ({op12.SQL})").fetchall())


def test_empty_table_and_lone_rows(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert N.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    assert N.nearest(spark.createDataFrame([(50, [1.0, 2.0])], schema), F.col("vec_id") % 50 == 0).count() == 0
    assert N.nearest(spark.createDataFrame([(51, [1.0, 2.0])], schema), F.col("vec_id") % 50 == 0).count() == 0
