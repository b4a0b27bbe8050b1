import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import parsing as L
from tidemark.llm.queries.op5 import op5


def names(text, levels=L.LEVELS):
    """Names of one text with the byte ranges of their phrases."""
    data = np.frombuffer(text.encode(), "uint8")
    symbols, offsets, begin = data, np.array([0, len(data)]), np.arange(len(data))
    for _ in range(levels):
        symbols, offsets, at = L.parse(symbols, offsets)
        begin = begin[at]
    return symbols.tolist(), begin.tolist()


def naive_level(symbols, value):
    """One level by its definition, symbol by symbol."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    labels = [r[0] for r in runs]
    for _ in range(3 if value is None else 4):
        new = []
        for i, x in enumerate(labels):
            d = x ^ (labels[i - 1] if i else x ^ 1)
            low = (d & -d).bit_length() - 1
            new.append(2 * low + (x >> low & 1))
        labels = new
    assert all(x < 6 for x in labels)
    starts = [i for i in range(len(runs)) if i == 0 or (i + 1 < len(runs) and labels[i] > labels[i - 1] and labels[i] > labels[i + 1])]
    phrases = [tuple(map(tuple, runs[a:b])) for a, b in zip(starts, [*starts[1:], len(runs)])]
    return phrases


@pytest.mark.parametrize("seed", range(5))
def test_phrases_equal_their_definition(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("aab cé") for _ in range(rng.randint(0, 120))) for _ in range(20)] + ["", "a", "aaaa", "ab"]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    got, at, _ = L.parse(np.frombuffer(b"".join(data), "uint8"), offsets)
    named = {}
    for i, d in enumerate(data):
        want = naive_level(list(d), None)
        mine = got[at[i]:at[i + 1]].tolist()
        assert len(mine) == len(want)
        for name, phrase in zip(mine, want):
            assert named.setdefault(phrase, name) == name
    assert len(set(named.values())) == len(named)
    upper, at2, _ = L.parse(got, at)
    for i in range(len(data)):
        assert at2[i + 1] - at2[i] == len(naive_level(got[at[i]:at[i + 1]].tolist(), 64))


def test_equal_substrings_share_interior_names():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    shared = " ".join(word() for _ in range(60))
    inside = None
    for _ in range(6):
        left = " ".join(word() for _ in range(rng.randint(1, 30)))
        n, b = names(left + " " + shared + " " + " ".join(word() for _ in range(5)))
        lo, hi = len(left) + 1 + 60, len(left) + 1 + len(shared) - 60
        own = [(x, y - len(left)) for x, y in zip(n, b) if lo <= y < hi]
        inside = inside or own
        assert own == inside and len(own) > 10


def test_likeness_tells_edits_from_strangers():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    base = [word() for _ in range(300)]
    edit = [w if rng.random() > 0.02 else word() for w in base]
    other = [word() for _ in range(300)]
    p, full = L.sketch(pa.array([" ".join(x) for x in (base, edit, other, base)] + ["", None]))
    near = lambda i, j: float(L.likeness(p[[i]], full[[i]], p[[j]], full[[j]])[0])
    assert near(0, 3) == 1 and near(0, 1) > 0.6 and near(0, 2) < 0.1 and near(4, 5) == 1 and near(0, 4) == 0


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows if i is not None))
    out = []
    for k, (i, t) in enumerate(rows):
        n = len(t) // 4
        out.append((i, len(t), hashlib.sha256((t[:len(t) - n] + rows[(k + 1) % len(rows)][1][:n]).encode()).hexdigest()))
    return sorted(out)


def test_query_on_the_tables(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = op5(spark, folder).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == brute(docs)
    texts, prints = dict(docs), {r["doc_id"]: r["fingerprint"] for r in rows}
    by_text = {}
    for i, t in texts.items():
        assert by_text.setdefault(t, prints[i]) == prints[i]
    long = [r for r in rows if r["n_chars"] > 1500]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.95
    assert 0.45 < np.median([r["near_edited"] for r in long]) < 0.75


def test_edge_rows(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abé 日") for _ in range(rng.randint(0, 50)))) for i in [*range(-5, 40), *range(250, 262), 900_000, 2**40, 2**40 + 1]]
    rows += [(7, rows[12][1]), (8, None), (9, ""), (None, "abcdefgh"), (None, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, block string").repartition(4)
    out = L.fingerprints(df).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out if r["doc_id"] is not None) == brute(rows)
    lone = {r["n_chars"]: r for r in out if r["doc_id"] is None}
    assert lone[8]["edited_sha256"] == hashlib.sha256(b"abcdef").hexdigest() and lone[8]["near_next"] == 0 and lone[0]["fingerprint"] == ""
    one = L.fingerprints(spark.createDataFrame([(3, "abcdefgh")], "doc_id bigint, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one[0]["near_next"] == 1
    assert L.fingerprints(df.limit(0)).count() == 0
