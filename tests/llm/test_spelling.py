import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import spelling as S
from tidemark.llm.queries import op13

RUN = re.compile("[A-Za-zÀ-ÿ]+")
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def brute_counts(rows, spoil):
    n = collections.Counter()
    for i, text in rows:
        for w in RUN.findall(text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            n[w if h % spoil else w[:h % len(w)] + w[h % len(w) + 1:]] += 1
    del n[""]
    return n


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, least_length=5, least_n=3):
    v = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_n}
    near = {w: [o for o in v if one_edit(w, o)] for w in v}
    form = {}
    for w in v:
        if near[w]:
            best = min(near[w], key=lambda o: (-v[o], o))
            if v[best] >= 2 * v[w]:
                form[w] = best
    out = []
    for w in v:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, v[w], len(near[w]), v[form[w]] if w in form else None))
    return sorted(out)


def corpus(seed, n, letters="abÀé"):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(60)] + ["x" * 5, "x" * 6, "x" * 7, "color", "colour", "long" * 40]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "-", "1", "Ā", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return rows + [(None, "color Color COLOR"), (n, None), (n + 1, ""), (n + 2, "Á1é日本ÿ×x ¿À"), rows[0], rows[0]]


@pytest.mark.parametrize("spoil", [97, 3])
def test_counts_equal_brute_force(spark, spoil):
    rows = corpus(1, 80, "abcdEÀé")
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, n int, word string").repartition(3)
    assert {r["word"]: r["n"] for r in S.word_counts(df, spoil).collect()} == dict(brute_counts(rows, spoil))


def test_checksums_of_any_length():
    words = ["a", "é" * 30, "b" * 48, "c" * 49, "d" * 5000, "long" * 100_000]
    ids = [0, -7, 12345678901]
    row, word = np.repeat(np.arange(3), 6), np.tile(np.arange(6), 3)
    size = np.array([len(w.encode()) for w in words])
    got = S.checksums(ids, row, np.array([zlib.crc32(w.encode()) for w in words], "uint32"), size, word)
    assert got.tolist() == [zlib.crc32(f"{ids[i]}:{words[j]}".encode()) for i, j in zip(row, word)]


def test_runs():
    texts = [None, "", "Ab1é", "日ÀÖ×÷ÿĀx", "don't", "é" * 3 + "A" * 5]
    found, row = S.runs(pa.array(texts))
    want = [(i, re.sub("[A-Z]", lambda m: m[0].lower(), w)) for i, t in enumerate(texts) for w in RUN.findall(t or "")]
    assert list(zip(row.tolist(), found.to_pylist())) == want


@pytest.mark.parametrize("tasks", [1, 7])
def test_trie_numbers(spark, tasks):
    """Equal prefixes have one number, others another, over batches and tasks."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(400)})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = S.trie_nodes(spark.createDataFrame([(w,) for w in words], "word string"), "trie-test").collect()
    finally:
        for c in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled"):
            spark.conf.unset(c)
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    number = {}
    for r in rows:
        assert len(r["nodes"]) == len(r["word"]) + 1
        for d, x in enumerate(r["nodes"]):
            assert number.setdefault(r["word"][:d], x) == x
    assert len(set(number.values())) == len(number)
    own = [r["nodes"][-1] for r in sorted(rows, key=lambda r: r["word"])]
    assert own == sorted(own)


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    counts = {"".join(rng.choice("abÀ") for _ in range(rng.randint(4, 8))): rng.choice([1, 2, 3, 4, 6, 9, 20, 50]) for _ in range(500)}
    counts |= {"x" * k: 2 ** k for k in range(4, 12)}  # runs of one letter, and a chain of forms
    df = spark.createDataFrame([(w, n) for w, n in counts.items()], "word string, n bigint").repartition(3)
    assert sorted(tuple(r) for r in S.variant_groups(df).select(*COLUMNS).collect()) == brute(counts)


def test_whole_query_equals_brute_force(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["word"]: tuple(r[c] for c in COLUMNS) for r in op13.op13(spark, folder).collect()}
    n = brute_counts(rows, 97)
    assert {w: g[3] for w, g in got.items()} == {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    assert sorted(got.values(), key=repr) == sorted(con.execute(f"select {', '.join(COLUMNS)} from ({op13.SQL})").fetchall(), key=repr)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert S.variant_groups(S.word_counts(empty)).count() == 0
    assert S.variant_groups(S.word_counts(spark.createDataFrame([(1, "lonely lonely lonely")], "doc_id bigint, text string"))).count() == 1
