import hashlib
import json
from datetime import date, datetime

import pyarrow as pa
import pytest

from pyspark.sql import functions as F
from tidemark.functions import broker as BK
from tidemark.functions import text as TX
from tidemark.operators import events as E


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("o")).first()["o"]


OBS = "id int, inst int, code string, day int, title string, document string, fact string"


def test_identity_stages(spark):
    rows = [
        (1, 1, "c", 1, "t1", "d1", "f1"), (2, 1, "c", 1, "t1", "d1", None),      # attaches by document
        (3, 1, "c", 1, "t1", None, None),                                          # attaches by title and date
        (4, 2, "c", 1, "t2", "d2", "f2"), (5, 2, "c", 1, "t2", "d2", "f3"),      # one document, two facts
        (6, 2, "c", 1, "zz", "d2", None),                                          # ambiguous document
        (7, 3, "c", 1, "t3", "d3", None), (8, 3, "c", 1, "t3", "d4", None),      # two documents, one title
        (9, 3, "c", 1, "t3", None, None),
        (10, 4, "c", 1, "t4", "d5", None), (11, 4, "c", 1, "t4", None, None),     # joins the only document
        (12, 5, "c", 1, "t5", None, None),
    ]
    df = spark.createDataFrame(rows, OBS)
    got = {r["id"]: (r["identity"], r["conflict"]) for r in E.assign_identity(df, ["inst", "code"], "fact", "document", "title", "day").collect()}
    assert got[2] == ("fact:f1", None) and got[3] == ("fact:f1", None)
    assert got[4][1] == got[5][1] == "external_fact_id_conflict"
    assert got[6] == (None, "ambiguous_external_fact_match")
    assert {got[i][1] for i in (7, 8, 9)} == {"ambiguous_document_match"}
    assert got[10] == got[11] == ("document:d5", None)
    assert got[12] == ("title:t5", None)
    assert len(got) == len(rows)


def chain(spark, revs):
    rows = [(1, n, role, None if at is None else datetime(2024, 1, at)) for n, role, at in revs]
    df = spark.createDataFrame(rows, "k int, rev int, role string, at timestamp_ntz")
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    return E.resolve_chains(df, ["k"], "rev", "role", "at", cut).first()["state"]


@pytest.mark.parametrize("revs,state", [
    ([(0, "initial", 2)], "active"),
    ([(0, "initial", 12)], "not_yet_available"),
    ([(0, "initial", 2), (2, "supersession", 3)], "revision_gap"),
    ([(0, "initial", 2), (1, "withdrawal", 3)], "withdrawn"),
    ([(0, "initial", 2), (1, "withdrawal", 12)], "active"),
    ([(0, "initial", 2), (1, None, 3)], "unknown_revision_role"),
    ([(0, "initial", 2), (1, "supersession", 3), (1, "withdrawal", 4)], "multi_source_revision_conflict"),
    ([(0, "supersession", 2)], "invalid_revision_sequence"),
    ([(0, "initial", 2), (1, "initial", 3)], "invalid_revision_sequence"),
    ([(0, "supersession", 2), (1, None, 3)], "invalid_revision_sequence"),
    ([(0, "initial", 2), (1, "initial", 3), (2, "supersession", 4), (2, "withdrawal", 4)], "invalid_revision_sequence"),
    ([(0, "initial", None)], "missing_reliable_first_available_at"),
])
def test_revision_states(spark, revs, state):
    assert chain(spark, revs) == state


def test_fold_and_counts(spark):
    assert one(spark, "ＡＢ Ｃ—Straße!", TX.title_key) == "abcstrasse"
    assert one(spark, "AI与AIGC,ai_x ai", lambda c: TX.ascii_token_count(TX.nfkc_fold(c), "ai")) == 2
    assert one(spark, "aaaa", lambda c: TX.literal_count(c, "aa")) == 2


def artifact(pages, **change):
    items = [{"pageNumber": i + 1, "text": p, "textSha256": hashlib.sha256(p.encode()).hexdigest(), "characterCount": len(p),
              "nonWhitespaceCharacterCount": len("".join(p.split()))} for i, p in enumerate(pages)]
    for k, v in change.items():
        items[0][k] = v
    return json.dumps(items)


@pytest.mark.parametrize("change,problem", [({}, None), ({"pageNumber": 2}, "page_numbers"), ({"textSha256": "0" * 64}, "page_hash"),
                                            ({"characterCount": 1}, "page_characters"), ({"nonWhitespaceCharacterCount": 1}, "page_non_whitespace")])
def test_document_artifacts(spark, change, problem):
    pages = ["one page", "zweite Seite"]
    text = TX.PAGE_BREAK.join(pages)
    df = spark.createDataFrame([(text, hashlib.sha256(text.encode()).hexdigest(), artifact(pages, **change))], "t string, s string, p string")
    assert df.select(TX.artifact_problem(F.col("t"), F.col("s"), F.col("p"), F.lit(2)).alias("o")).first()["o"] == problem


def test_titles(spark):
    assert one(spark, "甲公司:2024年年度报告", TX.report_kind) == "annual"
    assert one(spark, "2024年年度报告摘要", TX.report_kind) is None
    assert one(spark, "2024年第一季度报告", lambda c: TX.report_period(c, F.lit(True))) == date(2024, 3, 31)
    assert one(spark, "2023年业绩预告 扭亏为盈", TX.forecast_direction) == "turn_profitable"
    assert one(spark, "2023中报", TX.fiscal_label_end) == date(2023, 6, 30)
    assert one(spark, "2023季报", TX.fiscal_label_end) is None


@pytest.mark.parametrize("raw,want", [("1,234.50", 1234.5), ("(12)", -12.0), ("¥3.5", 3.5), ("--", None), ("HK$ 7", 7.0), ("abc", None)])
def test_numbers(spark, raw, want):
    got = one(spark, raw, BK.number)
    assert got is None if want is None else float(got) == want


@pytest.mark.parametrize("code,market,want", [
    ("600000", None, "600000.SH"), ("600000.SZ", None, None), ("700", "港股", "00700.HK"), ("00700", None, "00700.HK"),
    ("1", "深A", "000001.SZ"), ("830001", "沪市", None), ("920001", None, "920001.BJ"), ("600000", "某处", None), ("7", None, None),
])
def test_market_inference(spark, code, market, want):
    df = spark.createDataFrame([(code, market)], "c string, m string")
    assert BK.infer_market(df, "c", "m").first()["symbol"] == want


def test_dates(spark):
    assert one(spark, "2024/1/5 09:30:00", lambda c: BK.occurred(c, F.lit("Asia/Shanghai"))) == datetime(2024, 1, 5, 1, 30)
    assert one(spark, "20240105", BK.time_precision) == "date_only"
    assert one(spark, "2024-01-05 10:00", BK.time_precision) == "exact"


def test_ceil_second(spark):
    assert one(spark, datetime(2024, 1, 1, 0, 0, 0, 1), TX.ceil_second, "timestamp_ntz") == datetime(2024, 1, 1, 0, 0, 1)
    assert one(spark, datetime(2024, 1, 1), TX.ceil_second, "timestamp_ntz") == datetime(2024, 1, 1)


def test_normalisation_holds_few_texts_as_python_strings(spark):
    from tidemark.functions import text as TX

    held, most = [], []

    def fold(x):
        held.append(x)
        return x.upper()

    texts = pa.array([None, "", *["é" * 300_000] * 12, None, "ab"])
    real = pa.array
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pa, "array", lambda values, *rest: (most.append(sum(len(x.encode()) for x in values if x)), real(values, *rest))[1])
        out = TX.by_slices(texts, fold)
    assert out.to_pylist() == [None if x is None else x.upper() for x in texts.to_pylist()]
    assert max(most) <= TX.SLICE_BYTES + 600_000 and len(held) == 14
    rows = [(0, None), (1, ""), (2, "ﬁx Ⅳ"), (3, "Straße")]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r["i"]: (r["a"], r["b"]) for r in df.select("i", TX.nfkc("t").alias("a"), TX.nfkc_fold("t").alias("b")).collect()}
    assert got == {0: (None, None), 1: ("", ""), 2: ("fix IV", "fix iv"), 3: ("Straße", "strasse")}


def test_broker_rows_compile_to_short_methods(spark, folder):
    """The JIT compiler leaves methods of more than 8,000 bytes interpreted."""
    from tidemark.plans.text import l01

    stages = l01(spark, folder)._jdf.queryExecution().debug().codegenToSeq()
    assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000


def test_broker_codes_dates_and_words_of_odd_rows(spark):
    codes = {"600001": "600001.SH", " 600001.sh ": "600001.SH", "600001.SZ": None, "302132": "302132.SZ", "302133": None, "920001.BJ": "920001.BJ",
             "400001": "400001.BJ", "60000": None, "6000011": None, "600001.": None, "": None, None: None}
    dates = {"20240105": "2024-01-05", "2024/1/5 09:31": "2024-01-05 09:31", "2024-1-15": "2024-01-15", "2024-11-5": "2024-11-05", "2024-1-1234": "2024-01-1234",
             " 2024-01-05 ": "2024-01-05", "2024-123-4": "2024-123-4", "24-1-5": "24-1-5", "": "", None: None}
    words = {"融资买入": True, "x融券y": True, "margin.call": True, "卖出": False, "": False, None: None}
    for given, made in ((codes, BK.normalize_code), (dates, BK.normal_date_text), (words, lambda c: BK.has_any(c, BK.MARGIN_WORDS))):
        rows = spark.createDataFrame([(i, k) for i, k in enumerate(given)], "i int, t string").select("i", made(F.col("t")).alias("v")).collect()
        assert {r["i"]: r["v"] for r in rows} == dict(enumerate(given.values()))
