"""Announcement titles: the index of required literals must never change what the rules tell."""

import random
import re
import unicodedata

import pytest

from tidemark.functions.title_rules import COLUMN_CODES, ISSUER_TITLES, NEGATED, REVISED, TitleRule
from tidemark.operators import titles as TI


def plain(title):
    """The rules one after the other, in plain Python."""
    t = re.sub(r"\s+", "", unicodedata.normalize("NFKC", title or ""))
    if re.search(NEGATED, t) or re.search(REVISED, t):
        return None
    for r in ISSUER_TITLES:
        if re.search(r.pattern, t) and not (r.excluded and re.search(r.excluded, t)):
            return r.id
    return None


def pieces():
    return sorted({w for r in ISSUER_TITLES for p in (r.pattern, r.excluded or "") for w in re.split(r"[^\w]+|\.\*", p) if w})


def test_literals_are_required():
    assert TI.required_literals("(?:甲乙|丙)(?:丁)?戊己庚.*壬") == {"戊己庚"}
    assert TI.required_literals("甲乙?丙丁|(?:戊|己庚)辛") == {"丙丁", "辛"}
    for bad in ("(?:甲)?", "[甲乙]", "甲(?:乙"):
        with pytest.raises(ValueError):
            TI.required_literals(bad)
    words, rng = pieces(), random.Random(1)
    found = 0
    for _ in range(20_000):
        title = "".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
        for r in ISSUER_TITLES:
            if re.search(r.pattern, title):
                found += 1
                assert any(x in title for x in TI.required_literals(r.pattern)), (title, r.id)
    assert found > 2000


def test_every_rule_has_evidence():
    assert TI.accepted(ISSUER_TITLES) == ISSUER_TITLES
    first = TitleRule("broad", "code", "公告", sample="公告")
    shadowed = TitleRule("narrow", "code", "减持公告", sample="减持公告")
    assert TI.accepted((first, shadowed)) == (first,)
    assert TI.accepted((TitleRule("none", "code", "公告"),)) == ()


def test_titles_equal_plain_rules(spark):
    words, rng = pieces(), random.Random(2)
    titles = [None, "", " ", *[r.sample for r in ISSUER_TITLES], *[f"网传{r.sample}" for r in ISSUER_TITLES[:5]], "关于聘任副总经理的公告", "关于回购股份方案的更正公告", "ＡＢ 回购　股份 方案"]
    titles += ["".join(rng.choice([*words, "的", "公告", " ", "5%"]) for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    got = {r["id"]: (r["event_code"], r["method"], r["rule_id"]) for r in TI.classified(df, "title").collect()}
    codes = {r.id: r.code for r in ISSUER_TITLES}
    for i, t in enumerate(titles):
        rule = plain(t)
        assert got[i] == ((codes[rule], "title_rule", rule) if rule else (TI.UNCLASSIFIED, "unclassified", None)), t
    assert sum(v[1] == "title_rule" for v in got.values()) > 500


@pytest.mark.parametrize("title, columns, code, rule", [
    ("2023年年度报告", ["001001001001001"], "event.financial_results.annual_report", "column:001001001001001"),
    ("2023年年度报告摘要", ["001001001001001"], TI.UNCLASSIFIED, None),
    ("关于首次回购公司股份的公告", ["999"], "event.repurchase_capital.repurchase_first_execution", "repurchase-first-execution-v1"),
    ("回购股份方案修订", ["001002007003009001002"], "event.repurchase_capital.repurchase_change", "column:001002007003009001002"),
    ("回购股份方案取消修订", ["001002007003009001002"], TI.UNCLASSIFIED, None),
    ("2024年业绩预告", ["001002004002", "001002004001"], "event.financial_results.earnings_forecast_published", "column:001002004001"),
    ("网传业绩预告", ["001002004001"], TI.UNCLASSIFIED, None),
    (None, ["001002004001"], "event.financial_results.earnings_forecast_published", "column:001002004001"),
    (None, None, TI.UNCLASSIFIED, None),
])
def test_provider_codes_come_first(spark, title, columns, code, rule):
    df = spark.createDataFrame([(title, columns)], "title string, columns array<string>")
    r = TI.classified(df, "title", "columns").first()
    assert (r["event_code"], r["rule_id"]) == (code, rule) and set(COLUMN_CODES) >= {c for c in columns or [] if c != "999"}
