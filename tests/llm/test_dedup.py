import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import dedup as D
from tidemark.llm.components import components
from tidemark.llm.queries import op8

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute(rows, width, percent=80):
    """Component of each row's id by comparing all pairs."""
    s = [(i, sets(t, width)) for i, t in rows]
    root = {i: i for i, _ in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(s):
        for j, b in s[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) if i is not None else None for i, _ in s}, {i: len(x) for i, x in s}


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice("uvwxyz") + str(rng.randrange(50))
    return w


def corpus(seed, bases, copies):
    rng = random.Random(seed)
    rows = []
    for _ in range(bases):
        base = [rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.randint(8, 120))]
        for _ in range(rng.choice(copies)):
            rows.append(" ".join(edited(rng, base, rng.randint(0, max(1, len(base) // 16)))))
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("width", [2, 5])
def test_shingles_equal_brute_force(width):
    texts = [None, "", " ", "One", "a b", "A b a b a B c", "x y z w v u", "é é b", *[t for _, t in corpus(1, 6, [1])]]
    key, first = D.shingles(pa.array(texts), width)
    assert np.diff(first).tolist() == [len(sets(t, width)) for t in texts]
    got = [set(key[a:b].tolist()) for a, b in zip(first, first[1:])]
    for i in range(len(texts)):
        for j in range(i):
            assert len(got[i] & got[j]) == len(sets(texts[i], width) & sets(texts[j], width))


@pytest.mark.parametrize("width, limit", [(2, 48), (2, 4), (5, 48)])
def test_components_equal_brute_force(spark, monkeypatch, width, limit):
    monkeypatch.setattr(D, "NODE_LIMIT", limit)  # a low limit sends nodes to the deeper levels and to the pivots
    rows = corpus(7, 25, [1, 1, 2, 5, 14]) + [(9001, None), (9002, ""), (9003, " \n"), (9004, "one"), (9005, "One"), (9006, "one two"), (None, "one two")]
    rows += [(i + 10_000, t) for i, t in rows[:5]] + [rows[0]]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, node int").repartition(4)
    want, sizes = brute(rows, width)
    out = D.near_duplicates(df, width).collect()
    assert len(out) == len(rows)
    for r in out:
        i = r["doc_id"]
        assert (r["component_id"], r["n_shingles"]) == (want[i], sizes[i]), i
        assert r["kept"] == (i is None or want[i] == i)


@pytest.mark.parametrize("width", [2, 5])
def test_ids_with_several_texts(spark, width):
    words = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
    rows = [(1, words[0]), (1, words[1]), (2, words[0] + " more"), (3, words[1] + " more"), (4, words[2]), (5, words[2]), (5, words[3]), (6, words[3] + " x"),
            (7, words[4]), (7, words[4]), (8, words[5]), (9, words[5] + " y"), (9, None), (9, "")]
    rows += [(100 + i % 7, f"{words[i % 6]} tail{i}") for i in range(40)] + [(200 + i, t) for i, t in corpus(3, 6, [3])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want, _ = brute(rows, width)
    root = {}
    for i, _ in rows:  # rows of one id are one document
        root[i] = want[i]
    assert {(r["doc_id"], r["component_id"]) for r in D.near_duplicates(df, width).collect()} == set(root.items())
    small = spark.createDataFrame(rows[:4], "doc_id bigint, text string")
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in D.near_duplicates(small, width).collect()} == {(1, 1, True), (2, 1, False), (3, 1, False)}


def test_sql_and_spark_agree(spark, folder):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    cols = "doc_id, n_shingles, component_id, kept"
    want = sorted(con.execute(f"select {cols} from ({op8.SQL})").fetchall())
    got = sorted(tuple(r) for r in op8.op8(spark, folder).select(*cols.split(", ")).collect())
    assert got == want


def test_lanes_count_equal_tokens(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-2**31, 2**31, (2, D.TOKENS)).tolist()
    b[:20] = a[:20]
    df = spark.createDataFrame([(1, a), (2, b)], "doc bigint, tokens array<int>").select("doc", *D.sketch())
    from pyspark.sql import functions as F

    p, q = (df.filter(f"doc = {k}").select(F.struct(*D.SKETCH).alias(n)) for k, n in ((1, "p"), (2, "q")))
    assert p.join(q, F.lit(True)).select(D.equal_tokens("p", "q").alias("n")).first()["n"] == sum(x % 128 == y % 128 for x, y in zip(a, b))


def test_chain_and_star_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(200, 200 + k) for k in range(1, 40)] + [(500, 499), (499, 500), (7, 7)]
    rows = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert rows == {**{i: 0 for i in range(61)}, **{200 + k: 200 for k in range(40)}, 499: 499, 500: 499}


def test_empty_table(spark):
    assert D.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string"), 2).count() == 0
