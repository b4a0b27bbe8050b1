import collections
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import resampling as R
from tidemark.llm.queries.op3 import op3

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def features(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return w + list(zip(w, w[1:]))


def hashed(texts, buckets):
    """Bucket of each feature by its own text, to compare the counting and not the hash."""
    known = {}
    for f in {f for t in texts for f in features(t)}:
        text = f if isinstance(f, str) else " ".join(f)
        bucket, _ = R.buckets_of(pa.array([text]), buckets)
        known[f] = int(bucket[-1])
    return known


def test_query_equals_brute_force(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").limit(10**6).collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r["quality"] == 1}
    known, b = hashed(docs.values(), 10_000), 10_000
    raw, target = np.zeros(b), np.zeros(b)
    for i, t in docs.items():
        for f in features(t):
            raw[known[f]] += 1
            target[known[f]] += i in good
    ratio = np.log((target + 1) / (target.sum() + b)) - np.log((raw + 1) / (raw.sum() + b))
    want = {}
    for i, t in docs.items():
        weight = sum(ratio[known[f]] for f in features(t))
        u = int(hashlib.md5(f"3|{i}".encode()).hexdigest()[:13], 16) / 2**52 + 0.5 / 2**52
        want[i] = (len(features(t)), weight, weight - math.log(-math.log(u)))
    kept = set(sorted(want, key=lambda i: -want[i][2])[:int(0.9 * len(want))])
    rows = op3(spark, folder).collect()
    assert len(rows) == len(want)
    for r in rows:
        w = want[r["doc_id"]]
        assert r["n_features"] == w[0] and r["log_weight"] == pytest.approx(w[1], abs=1e-6)
        assert r["rank_key"] == pytest.approx(w[2] * R.SCALE, abs=2) and r["kept"] == (r["doc_id"] in kept)


def test_good_texts_are_kept_on_larger_tables(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    kept = {r["doc_id"]: r["kept"] for r in op3(spark, folder).collect()}
    by = collections.defaultdict(list)
    for r in spark.read.parquet(f"{folder}/labels.parquet").collect():
        by[r["quality"]].append(kept[r["doc_id"]])
    assert np.mean(by[1]) > 0.93 and np.mean(by[0]) < 0.6


@pytest.mark.parametrize("values", [[5, 5, 5, 5], [1, 9, 3, 7, 7, 2], list(range(-20_000, 20_000, 7)), [-2**40, 2**40, 0, 3]])
def test_kth_largest(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    for k in (1, 2, len(values) // 2, len(values)):
        want = sorted(values, reverse=True)[k - 1]
        assert R.kth_largest(df, "v", k) == (want, sum(v > want for v in values))


def test_edge_rows(spark):
    rows = [(i, "good words here", 1) for i in range(20)] + [(50, None, 1), (51, "", 1), (None, "good", 1), (3, "good words here", 1), (60, "bad " * 30_000, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, is_target int")
    targets = spark.createDataFrame([(i,) for i in range(10)] + [(None,)], "doc_id bigint")
    out = R.resample(df, targets, keep_fraction=0.5).collect()
    assert len(out) == len(rows) and sum(r["kept"] for r in out) in (11, 12)  # two rows of one id are kept or not together
    assert {r["doc_id"]: r["log_weight"] for r in out}[50] == 0 and not {r["doc_id"]: r["kept"] for r in out}[60]
    assert R.resample(df.limit(0), targets).count() == 0
    assert R.resample(df, targets.limit(0)).count() == len(rows)
