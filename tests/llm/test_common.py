import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import common as C

WORD = re.compile(C.WORD)


@pytest.mark.parametrize("seed", range(4))
def test_words_and_hashes_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(["a", "B", "é", " ", "\n", "\x0b", "x", "日"]) for _ in range(rng.randint(0, 40))) for _ in range(50)] + [None, "", " ", "A"]
    w = C.Words(pa.array(texts))
    want = [WORD.findall(t or "") for t in texts]
    assert w.counts.tolist() == [len(x) for x in want]
    data = w.data.tobytes()
    assert [data[a:b].decode() for a, b in zip(w.starts, w.ends)] == [x for t in want for x in t]
    for fold in (True, False):
        named = {}
        for h, x in zip(w.hashes(fold).tolist(), (x for t in want for x in t)):
            x = re.sub("[A-Z]+", lambda m: m[0].lower(), x) if fold else x
            assert named.setdefault(x, h) == h
        assert len(set(named.values())) == len(named)


def test_slices_hold_every_row_once():
    batch = pa.record_batch([pa.array(range(9)), pa.array(["x" * n for n in (0, 5 << 20, 1, 1, 3 << 20, 2 << 20, 0, 1, 9 << 20)])], names=["i", "t"])
    parts = list(C.slices(batch, 1))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(9)) and len(parts) > 3


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "b", 2)], ["doc_id", "TEXT", "text", "Doc_Id"])
    assert C.pick(df, ["doc_id", "text"]).collect() == [(1, "b")]
    twice = spark.createDataFrame([(1, "a", "b")], ["doc_id", "x", "y"]).toDF("doc_id", "text", "text")
    assert C.pick(twice, ["text", "doc_id"]).collect() == [("a", 1)]


def test_uniform_is_spread(spark):
    from pyspark.sql import functions as F

    u = np.array([r["u"] for r in spark.range(2000).select(C.uniform(F.lit(1), "id").alias("u")).collect()])
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.03


def test_discarding_lets_the_driver_collect_its_garbage(spark):
    from tidemark.session import discard, materialise

    beans = list(spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    made = materialise(spark.range(3), "made")
    before = sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    discard(made)
    assert sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName()) > before
