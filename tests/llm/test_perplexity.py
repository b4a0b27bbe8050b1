import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import perplexity as P
from tidemark.llm import wordmodel as M
from tidemark.llm.queries.op4 import op4

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i:i + 8])].append(i)
    again = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again)]


def random_text(rng):
    words = [rng.choice(["a", "b", "É", "<x>", "日本", "a"]) for _ in range(rng.randint(0, 60))]
    return "".join(w + rng.choice([" ", " ", "\n", "\t ", "\n\n", " \n", "\x0b"]) for w in words)


@pytest.mark.parametrize("seed", range(6))
def test_statistics_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = [random_text(rng) for _ in range(40)] + [None, "", " \n", "x", "a\na", "a \na", "\n\na\n\na"]
    got = P.statistics(pa.array(texts))
    for i, t in enumerate(texts):
        assert [int(got[c][i]) for c in P.STATS[:5]] == brute(t), t


def test_query_on_the_tables(spark, folder):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op4(spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r["doc_id"]]["text"])
        assert [r[c] for c in P.STATS[:5]] == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert np.mean(good) > 0.98


def naive(texts):
    """Modified Kneser-Ney by its definition over tuples of classes."""
    grams = collections.Counter()
    for t in texts:
        c = [int(P._CLASS[10])] * 3 + [int(P._CLASS[b]) for b in t.encode()]
        grams.update(tuple(c[i:i + 4]) for i in range(len(c) - 3))
    counts = {4: grams}
    for n in (3, 2, 1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / P.CLASSES
        d = P.discounts(np.array(list(counts[n].values())))
        own = {k: v for k, v in counts[n].items() if k[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        total, c = sum(own.values()), counts[n].get(g, 0)
        return (c - d[min(c, 3)]) / total + sum(d[min(v, 3)] for v in own.values()) / total * p(g[1:])

    return grams, p


def test_model_equals_its_definition_and_sums_to_one():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc d.é") for _ in range(rng.randint(1, 80))) for _ in range(30)]
    grams, p = naive(texts)
    code = {g: sum(c * P.CLASSES ** (3 - i) for i, c in enumerate(g)) for g in grams}
    dense = P.kneser_ney(np.array([code[g] for g in grams]), np.array(list(grams.values()))).dense()
    for g in list(grams)[:60] + [(1, 2, 3, 40), (40, 41, 0, 1), (28, 28, 28, 5)]:
        assert dense[sum(c * P.CLASSES ** (3 - i) for i, c in enumerate(g))] == pytest.approx(np.log10(p(g)), abs=1e-4)
    sums = (10.0 ** dense.astype(float)).reshape(-1, P.CLASSES).sum(axis=1)
    assert np.allclose(sums, 1, atol=1e-3)


def test_bands_reject_odd_texts_by_language(spark):
    rng = random.Random(4)
    plain = lambda s: " ".join("".join(rng.choice(s) for _ in range(2)) for _ in range(60))
    rows = [(i, plain(["na", "ti", "re"]), "xx") for i in range(150)] + [(i + 200, plain(["lo", "mu", "ka"]), None) for i in range(150)]
    rows += [(900, " ".join("".join(rng.choice("qxzjkwv%#") for _ in range(7)) for _ in range(60)), "xx"), (901, None, "xx"), (902, "", None), (None, rows[0][1], "xx")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("band", F.lit(1))
    kept = {r["doc_id"]: r["kept"] for r in P.quality(df).collect()}
    assert not kept[900] and not kept[901] and not kept[902] and kept[None]
    assert np.mean([v for k, v in kept.items() if k is not None and k < 900]) > 0.98


@pytest.mark.parametrize("labelled", [False, True])
def test_a_third_of_junk_does_not_move_the_bands(spark, labelled):
    rng = random.Random(5)
    text = lambda parts, k, n: " ".join("".join(rng.choice(parts) for _ in range(k)) for _ in range(n))
    junk = 200 if labelled else 60  # with labels even a majority
    rows = [(k * 1000 + i, text(["na", "ti", "re", "so"], 2, 60), lang) for k, lang in enumerate(["xx", None]) for i in range(110)]
    rows += [(k * 1000 + 500 + i, text("qxzjkwv%#", 7, 60), lang) for k, lang in enumerate(["xx", None]) for i in range(junk)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k * 1000 + i, int(i < 500), 0) for k in (0, 1) for i in (*range(0, 110, 3), 500, 510)] + [(0, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in P.quality(df, **({"labels": labels} if labelled else {})).collect()}
    assert len(kept) == len(rows)
    for k in (0, 1000):
        assert np.mean([kept[k + i] for i in range(110)]) > 0.95
        assert not any(kept[k + 500 + i] for i in range(junk))


def test_fences_without_junk_are_those_of_quartiles():
    bins, n = np.arange(100, 140), np.concatenate([np.arange(1, 21), np.arange(20, 0, -1)])
    upto = np.cumsum(n)
    q1, q3 = (int(bins[np.argmax(4 * upto >= k * upto[-1])]) for k in (1, 3))
    assert P.fences(bins, n, 0 * n, 3.0) == (q1 - 3.0 * (q3 - q1), q3 + 3.0 * (q3 - q1))
    assert P.fences(np.array([7]), np.array([1]), np.array([0]), 3.0) == (-8, 22)


def test_empty_table(spark):
    assert P.quality(spark.createDataFrame([], "doc_id bigint, text string, lang string")).count() == 0


def words_of(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")] + ["\n"]


def left_out(texts, spelt):
    """Word scores by their definition: for each text, counts of all others."""
    pairs = [collections.Counter(zip(["\n", *words_of(t)], words_of(t))) for t in texts]
    every = sum(pairs, collections.Counter())
    tally = lambda c: P.discounts(np.array(list(c.values())))
    d, e = tally(every), tally(collections.Counter(w for _, w in every))
    out = []
    for t, own in zip(texts, pairs):
        rest = every - own
        before, total, words = collections.Counter(w for _, w in rest), collections.Counter(), collections.Counter()
        for (u, w), n in rest.items():
            total[u] += n
            words[w] += n
        mass = sum(e[min(n, 3)] for n in before.values())
        log, order = 0.0, 0.0
        for u, w in zip(["\n", *words_of(t)], words_of(t)):
            p1 = (before[w] - e[min(before[w], 3)] + mass * spelt(w)) / len(rest) if rest else spelt(w)
            n, p = rest[u, w], p1
            if total[u]:
                p = (n - d[min(n, 3)] + p1 * sum(d[min(x, 3)] for (a, _), x in rest.items() if a == u)) / total[u]
            log += np.log10(p)
            order += np.log10(p) - np.log10(words[w] / sum(words.values()) if words[w] else p1)
        size = len(words_of(t))
        out.append((log / size, order / size) if size > 1 else (None, None))
    return out


@pytest.mark.parametrize("chunk, block", [(2_000_000, 400_000), (40, 25)])
def test_words_are_scored_by_the_other_texts(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(M, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(M, "BLOCK_TOKENS", block)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "A", "ab", "É", "c,", "dd", "e" * rng.randint(1, 9)]) for _ in range(rng.randint(1, 40))) for _ in range(25)]
    texts += [texts[0], texts[1], None, "", "only here", "a"]
    spell = lambda data, offsets: -np.diff(offsets) / 2.0  # noqa: E731  half a power of ten for each byte and the two blanks

    def describe(batch):
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64())], names=["doc_id"])

    for some in (texts, texts[:1]):
        df = spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string").withColumn("lang", F.lit("xx")).repartition(3)
        got = {r["doc_id"]: (r["word_log"], r["order_log"]) for r in M.word_scores(df, describe, "doc_id bigint", spell, P.discounts_of)[0].collect()}
        want = left_out(some, lambda w: 10.0 ** (-(len(w.strip().encode()) + 2) / 2))
        assert len(got) == len(some)
        for i, w in enumerate(want):
            assert got[i] == pytest.approx(w, abs=1e-9) if w[0] is not None else got[i] == w, some[i]


def test_senseless_order_is_rejected_and_copies_are_kept(spark):
    """Classes of bytes, the only model before, see the spelling of the right words and keep these texts."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["na", "ti", "re", "so", "lu"]) for _ in range(3))
    after = {w: rng.sample(range(90), 3) for w in range(90)}
    words = [word() for _ in after]

    def text():
        at, out = rng.randrange(90), []
        for _ in range(80):
            out.append(words[at])
            at = rng.choice(after[at])
        return out

    good = [text() for _ in range(160)]
    odd = [rng.sample(t, len(t)) for t in (text() for _ in range(12))]
    rows = [(i, " ".join(t), "xx") for i, t in enumerate(good)] + [(1000 + i, " ".join(t), "xx") for i, t in enumerate(good[:40])] + [(2000 + i, " ".join(t), "xx") for i, t in enumerate(odd)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 160, 2)], "doc_id bigint, quality int")
    out = {r["doc_id"]: r for r in P.quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), labels=labels).collect()}
    assert not any(r["kept"] for i, r in out.items() if i >= 2000)
    assert all(r["low"] <= r["bin"] <= r["high"] for i, r in out.items() if i >= 2000)  # what the classes say
    assert np.mean([r["kept"] for i, r in out.items() if i < 1000]) > 0.95
    assert np.mean([r["kept"] for i, r in out.items() if 1000 <= i < 2000]) > 0.95
