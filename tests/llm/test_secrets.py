import hashlib
import itertools
import math
import re

import pytest

from tidemark.llm import secrets as S
from tidemark.llm.queries.op2 import op2

BASE = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))


def brute_base(text):
    out = []
    for n, (kind, pattern, group, least) in enumerate(BASE):
        out += [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [s for _, _, s in sorted(out)]


TEXTS = ["token: token: abcdefgh", 'é "api_key" : "sk-live_0a9f8e7d6c5b4a39"', "AKIA" + "B" * 15 + " AKIA" + "C" * 16, "f" * 23 + "g" + "0" * 24 + "é", "PASSWORD==abc123x",
         "tokeſ: abcdefg toKen = abcdefg", "", None, " ", "pwd = Tr0ub4dor&3xK9", "my password is hunter2Qz81!kk.", "the secret is kindness today", "password is password1",
         "login: qwertyuiop", "passphrase: aaaaaaaaaaaaaaaa", "pwd: 2024-01-15", "a" * 200_000 + " token=" + "9f" * 400, "secret:\npassword=abcdef" + "0123456789abcdef" * 2]


def test_spans_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)] + [(None, TEXTS[1], 0), (0, TEXTS[0], 1)], "doc_id bigint, text string, spans int")
    rows = S.scan(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r["doc_id"] is not None:
            got = [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] != "guess"]
            assert got == brute_base(TEXTS[r["doc_id"]])
    guessed = {r["doc_id"] for r in rows if any(s["kind"] == "guess" for s in r["spans"])}
    assert guessed == {9, 10}


def test_query_on_the_tables(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")  # the smallest tables hold hardly a secret
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op2(spark, folder).collect()
    assert len(rows) == len(texts)
    assert sum(r["n_assign"] for r in rows) > 3 and sum(r["n_hex"] for r in rows) > 0
    for r in rows:
        want = brute_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s.startswith(k + ":") for s in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(r["spans"].split(",") if r["spans"] else [])


@pytest.mark.parametrize("text, value", [
    ("login password: Zx9#kk!pQ", "Zx9#kk!pQ"), ("auth token: Zx9#kk!pQ", "Zx9#kk!pQ"), ("login credentials: V7#kd!9w", "V7#kd!9w"), ("token secret password: Zx9#kk!pQ.", "Zx9#kk!pQ"),
    ("dbPassword: Zx9#kk!pQ", "Zx9#kk!pQ"), ("accessToken = Zx9#kk!pQ", "Zx9#kk!pQ"),
    ('passphrase: "vexing quartz hamster 41 plum"', "vexing quartz hamster 41 plum"), ("pwd='kq vz!x 93 it\"s'", 'kq vz!x 93 it"s')])
def test_every_credential_word_and_whole_quoted_values(spark, text, value):
    assert [text[a:b] for a, b, _ in S.find_spans(text, 8.0)] == [value]
    row = S.redact(spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id bigint, text string, lang string, source string, n_chars bigint")).first()
    assert row["text"] == text.replace(value, "[SECRET]")


@pytest.mark.parametrize("text", ["compassword: Zx9#kk!pQ", "the mistoken: Zx9#kk!pQ", "login page shows the password field today"])
def test_words_that_only_end_like_a_credential_word(text):
    assert S.find_spans(text, 8.0) == []


def brute_cost(value):
    """Every segmentation; each part by the cheapest kind that can be the whole part."""
    low = value.lower()

    def part(i, j):
        s, v = low[i:j], value[i:j]
        costs = [sum(S._brute(c) for c in v)]
        word = S.RANK.get(s) or S.RANK.get(s.translate(S.LEET))
        if word and len(s) >= 3:
            costs.append(math.log10(word + 1) + (0.3 if v != s else 0) + (0 if s in S.RANK else 0.3))
        m = S.DATE.match(low, i)
        if m and m.end() == j:
            costs.append(2.1 if j - i == 4 else 4.6)
        return min(costs)

    n = len(value)
    return min(sum(part(i, j) for i, j in itertools.pairwise([0, *cuts, n])) + S.JOIN * len(cuts)
               for k in range(n) for cuts in itertools.combinations(range(1, n), k))


@pytest.mark.parametrize("value", ["x7secret", "Passwordq", "k2019z", "l0vemek", "zq9kd", "adminroot", "9love2001"])
def test_cost_is_the_cheapest_segmentation(value):
    assert S.guess_cost(value) <= brute_cost(value) + 1e-9
    assert S.guess_cost(value) >= brute_cost(value) - 2 * S.JOIN * len(value)


@pytest.mark.parametrize("weak, strong", [("password123", "pq9Xm2Lr7"), ("qwertyuiop", "qmxnwbzvpr"), ("aaaaaaaaaaaa", "akqpzmwxnsjd"), ("abcabcabcabc", "abkqmzwpxvnd"), ("2001-02-03", "2q01xk0z03")])
def test_patterns_are_cheap(weak, strong):
    assert S.guess_cost(weak) < 8 < S.guess_cost(strong)


def test_redaction(spark):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows = {r["doc_id"]: r for r in S.redact(df).collect()}
    assert rows[2]["text"] == TEXTS[2][:19] + " [SECRET]"
    assert rows[7]["text"] is None and rows[11]["text"] == TEXTS[11]
    assert all(not brute_base(r["text"]) for r in rows.values())
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values() if r["text"] is not None)
    assert S.redact(df.limit(0)).count() == 0
