import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.packing import WordTokenizer, pack, plan_bins

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [None, "", " ", "The cat's 12 hats.", "a^b ^ ^^", "x<|endoftext|>y <|startoftext|>", "ÀÉ é ça va là ΟΔΟΣ ς",
        "tab\tline\nreturn\rvt\x0bff\x0cend", "don't WE'LL they've", "the.*** a.b,c!! ñ&&& 555-3296", "日本語 テスト 🙂🙂 ​́x", "a" * 9000,
        "İstanbul ſtraße KK", "x.́y zͅ"]


def test_word_ids_equal_whole_text_ids():
    tok, whole = WordTokenizer(PATH), Tokenizer.from_file(PATH)
    ids, at = tok.encode(pa.array(HARD))
    for i, t in enumerate(HARD):
        assert ids[at[i]:at[i + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


def test_frequent_words_are_encoded_once_however_many_others_pass(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 60)
    tok, whole, sent = WordTokenizer(PATH), Tokenizer.from_file(PATH), []
    plain = tok._plain
    monkeypatch.setattr(tok, "_plain", lambda texts: sent.extend(texts) or plain(texts))
    for k in range(12):
        texts = ["Alpha beta, gamma.", *[f"w{k}x{i}q; a^{k}" for i in range(40)], None, "beta,"]
        ids, at = tok.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i]:at[i + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids
    assert sum(w == "beta" for t in sent for w in t.split()) == 1


def brute(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_piecewise_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 50])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 300))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    used = {}
    for length, _, number, first, per, offset in plan_bins(counts, capacity):
        for k in range(number):
            used.setdefault(first + k // per, []).append((offset + k % per * length, length))
    rooms = []
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
        rooms.append(capacity - at)
    assert sum(len(s) for s in used.values()) == len(lengths)
    assert sorted(rooms) == brute(lengths, capacity)


def test_pack_round_trip(spark):
    rng = random.Random(5)
    texts = HARD + [" ".join(rng.choice(["alpha", "Beta,", "γάμμα", "42"]) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, part string").repartition(3)
    out = [r.asDict() for r in pack(df, PATH, 128, with_ids=True).collect()]
    whole = Tokenizer.from_file(PATH)
    by_doc = {}
    for r in out:
        assert len(r["ids"]) == r["length"] <= 128
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t, _ in rows:
        want = whole.encode(t or "", add_special_tokens=False).ids + [0]
        got = sorted(by_doc[i], key=lambda r: r["piece"])
        got = got[::2] if i == 7 and len(got) > 1 and got[0]["piece"] == got[1]["piece"] else got
        assert sum((r["ids"] for r in got), []) == want
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in seqs.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
    assert len(seqs) == len(brute([r["length"] for r in out], 128))


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0
