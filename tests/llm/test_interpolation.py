import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import exchange as X
from tidemark.llm import interpolation as I
from tidemark.llm.queries.op7 import op7

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = "\n"


def tokens(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")] + [END]


def brute(docs):
    fold = lambda i: {2: 2, 3: 1}.get(zlib.crc32(str(i).encode()) % 7, 0) if i is not None else 0
    uni, bi = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for i, t in docs:
        if fold(i) < 2:
            seq = [END, *tokens(t)]
            uni[fold(i)].update(seq[1:])
            bi[fold(i)].update(zip(seq, seq[1:]))
    both, both2 = uni[0] + uni[1], bi[0] + bi[1]
    n, n0, v = sum(both.values()), sum(uni[0].values()), len(both)
    held, wide = collections.Counter(), I.LOWEST + 1
    for i, t in docs:
        if fold(i) == 1:
            seq = [END, *tokens(t)]
            for a, b in zip(seq, seq[1:]):
                p2, p1 = bi[0][a, b] / max(uni[0][a], 1), uni[0][b] / max(n0, 1)
                key = [int(x) for x in (I._bucket(np.array([uni[0][a]]))[0], I._bin(np.array([p2]))[0], I._bin(np.array([p1]))[0])]
                held[(key[0] * wide + key[1]) * wide + key[2]] += 1
    keys = np.array(sorted(held), dtype="int64")
    weights = I.expectation_maximisation(keys, np.array([held[k] for k in keys], dtype="int64"), v, 60)
    out = {}
    for i, t in docs:
        seq, score, base = [END, *tokens(t)], 0.0, 0.0
        for a, b in zip(seq, seq[1:]):
            w = weights[int(I._bucket(np.array([both[a]]))[0])]
            score += math.log10(w[0] * both2[a, b] / max(both[a], 1) + w[1] * both[b] / max(n, 1) + w[2] / (v + 1))
            base += math.log10((both[b] + 1) / (n + v + 1))
        out[i] = (fold(i) == 2, len(seq) - 1, sum(both[b] > 0 for b in seq[1:]), n, base, score)
    return out, weights


def same(rows, want):
    assert len(rows) == len(want)
    for r in rows:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4], abs=1e-6) and r["score"] == pytest.approx(w[5], abs=1e-6)


def test_query_equals_brute_force(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want, weights = brute(docs)
    rows = op7(spark, folder).collect()
    same(rows, want)
    assert np.allclose(weights.sum(axis=1), 1)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # the model explains unseen texts better


def test_edge_rows_over_many_chunks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["A", "a", "bé", "c", "D,", "\n"]) for _ in range(rng.randint(0, 30))), "x") for i in range(120)]
    rows += [(500, None, "x"), (501, "", "x"), (None, "a c A", "x"), (502, "z " * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fold string").repartition(5)
    same(I.language_model_scores(df).collect(), brute([r[:2] for r in rows])[0])
    assert I.language_model_scores(df.limit(0)).count() == 0
    held = df.filter("crc32(cast(doc_id as string)) % 7 = 2")
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in I.language_model_scores(held).collect())


def test_squeeze_round_trip():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype("uint64"))
    assert (X.expand_sorted(X.squeeze_sorted(x)) == x).all()
    assert len(X.expand(X.squeeze(np.zeros(0, "uint32")), "uint32")) == 0
    assert (np.diff(X.range_of(np.append(x, np.uint64((1 << 64) - 1)), 7)) >= 0).all()
