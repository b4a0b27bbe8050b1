import random
import zlib

import numpy as np

from tidemark.llm import langid
from tidemark.llm.queries.op9 import op9

SYLLABLES = {"aa": ["ka", "ki", "ku"], "bb": ["lo", "le", "la"], "cc": ["éta", "çou", "ñi"]}


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_held_out_accuracy_on_the_tables(spark, folder):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = op9(spark, folder).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(truth)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in out if r["held_out"] and truth[r["doc_id"]]]
    assert len(held) > 20
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert np.mean([r["rejected"] for r in held]) < 0.03


def test_windows_equal_a_loop():
    texts = ["ab cd", "", "Abcde f", "éa"]
    data = np.frombuffer("".join(texts).encode(), "uint8")
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    bucket, row = langid.windows(data, offsets, 1 << 16)
    for i, t in enumerate(texts):
        b = t.encode().lower()
        want = sum(1 for n in langid.SIZES for k in range(len(b) - n + 1) if b" " not in b[k + 1:k + n - 1])
        assert (row == i).sum() == want


def test_edge_rows(spark):
    rows = [(i, t, l, "x") for i, t, l in corpus(400)]
    odd = [(1000, None, "aa", "x"), (1001, "", None, "x"), (1002, "123 456 ²", "bb", "x"), (None, "kaki kuku kika", None, "x"), (1003, "日本", None, "x"),
           (0, rows[0][1], rows[0][2], "x"), (1004, "lole " * 50_000, None, "x"), (1005, "5 é", None, "x")]
    df = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string, score string")
    model = langid.train(df, ~langid.held_out(), max_docs=300)
    out = {}
    for r in langid.predict(df, model).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert [out[k][0]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3
    assert all(out[k][0]["rejected"] and out[k][0]["score"] == 0 for k in (1000, 1001, 1002))
    assert out[None][0]["lang_pred"] == "aa" and out[1004][0]["lang_pred"] == "bb"
    assert out[1003][0]["lang_pred"] in SYLLABLES and out[1003][0]["rejected"]
    assert out[1005][0]["lang_pred"] in SYLLABLES
    assert len(out[0]) == 2 and out[0][0] == out[0][1]


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame([(1, "kaki", None)], "doc_id bigint, text string, lang string")
    model = langid.train(df, ~langid.held_out())
    assert model is None
    assert langid.predict(df, model).collect()[0]["lang_pred"] == "und"
    assert langid.predict(df.limit(0), model).count() == 0
