"""Text functions: Unicode folding, term counts, document artifacts, titles."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


SLICE_BYTES = 1 << 20  # of text that is a Python string at a time; a batch may hold 10,000 long texts


def by_slices(texts: pa.Array, fn: Callable[[str], str]) -> pa.Array:
    """``fn`` of each text that is not null, slice after slice, so that only one slice is held as Python strings."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype("int64")
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1).tolist(), len(texts)]
    done = [pa.array([None if x is None else fn(x) for x in texts.slice(a, b - a).to_pylist()], pa.string()) for a, b in zip(edges, edges[1:])]
    return pa.concat_arrays(done)


@F.arrow_udf(T.StringType())
def nfkc(s: pa.Array) -> pa.Array:
    """Compatibility normalisation; Spark has no built-in for it."""
    return by_slices(s, lambda x: unicodedata.normalize("NFKC", x))


@F.arrow_udf(T.StringType())
def nfkc_fold(s: pa.Array) -> pa.Array:
    """Compatibility normalisation followed by full case folding."""
    return by_slices(s, lambda x: unicodedata.normalize("NFKC", x).casefold())


def title_key(text: Column) -> Column:
    """Folded title without punctuation, spacing and symbols."""
    return F.regexp_replace(nfkc_fold(text), r"[^\p{L}\p{N}_]+", "")


def squeezed(text: Column) -> Column:
    return F.regexp_replace(nfkc(text), r"(?U)\s+", "")


def literal_count(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term in already folded text."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))
    return F.floor(gone / len(term)).cast("long")


def ascii_token_count(text: Column, term: str) -> Column:
    """Occurrences bounded by anything but ASCII letters, digits and underscore."""
    pattern = rf"(?<![A-Za-z0-9_]){re.escape(term)}(?![A-Za-z0-9_])"
    return F.regexp_count(text, F.lit(pattern)).cast("long")


PAGE = "array<struct<pageNumber:int,text:string,textSha256:string,characterCount:int,nonWhitespaceCharacterCount:int>>"
PAGE_BREAK = "\n\f\n"


def artifact_problem(text: Column, text_sha: Column, pages_json: Column, page_count: Column) -> Column:
    """First violated rule of a frozen document artifact, NULL when it replays exactly."""
    pages = F.from_json(pages_json, PAGE)
    numbers = F.transform(pages, lambda p: p["pageNumber"])
    return (
        F.when(F.sha2(text, 256) != text_sha, "text_hash")
        .when(pages.isNull(), "pages_shape")
        .when(F.size(pages) != page_count, "page_count")
        .when(numbers != F.sequence(F.lit(1), page_count), "page_numbers")
        .when(F.exists(pages, lambda p: F.trim(p["text"]) == ""), "empty_page")
        .when(F.exists(pages, lambda p: F.sha2(p["text"], 256) != p["textSha256"]), "page_hash")
        .when(F.exists(pages, lambda p: F.length(p["text"]) != p["characterCount"]), "page_characters")
        .when(
            F.exists(pages, lambda p: F.length(F.regexp_replace(p["text"], r"(?U)\s", "")) != p["nonWhitespaceCharacterCount"]),
            "page_non_whitespace",
        )
        .when(F.array_join(F.transform(pages, lambda p: p["text"]), PAGE_BREAK) != text, "rebuild")
    )


# Endings of issuer report titles.
ANNUAL = r"(?:^|:)20\d{2}年?年度报告$"
SEMIANNUAL = r"(?:^|:)20\d{2}年?(?:半年度|半年)报告$"
QUARTERLY = r"(?:^|:)20\d{2}年?(?:第?[一1]季度|第?[三3]季度)报告$"
NOT_INITIAL = r"(?:摘要|英文版|外文版|更正|修订|取消|撤回|撤销|更新版?|补充公告|补充说明)"
# Forecast directions in the order in which they are tried.
DIRECTIONS = (
    ("turn_profitable", "扭亏(?:为盈)?"),
    ("first_loss", "首亏"),
    ("continued_loss", "续亏"),
    ("continued_profit", "续盈"),
    ("increase", "预增|略增"),
    ("decrease", "预减|略减"),
)


def report_kind(title: Column) -> Column:
    """annual, semiannual or quarterly for an initial complete report, else NULL."""
    return F.when(
        ~title.rlike(NOT_INITIAL),
        F.when(title.rlike(ANNUAL), "annual").when(title.rlike(SEMIANNUAL), "semiannual").when(title.rlike(QUARTERLY), "quarterly"),
    )


def report_period(title: Column, quarterly: Column) -> Column:
    """Period end named by a title; a plain year means December unless the report is quarterly."""
    year = F.regexp_extract(title, r"(?:^|[^0-9])(20\d{2})年", 1)
    y = F.when(year != "", year.cast("int"))
    first = F.contains(title, F.lit("一季度"))
    half = F.contains(title, F.lit("半年"))
    third = F.contains(title, F.lit("三季度"))
    month = F.when(first, 3).when(half, 6).when(third, 9).when(~quarterly, 12)
    return F.last_day(F.make_date(y, month, F.lit(1)))


def forecast_direction(title: Column) -> Column:
    return F.coalesce(*[F.when(title.rlike(p), F.lit(n)) for n, p in DIRECTIONS], F.lit("unspecified"))


def fiscal_label_end(label: Column) -> Column:
    """``YYYY一季报/中报/半年报/三季报/年报`` to the period end; NULL for anything else."""
    pattern = r"^(\d{4})(一季报|中报|半年报|三季报|年报)$"
    year = F.when(label.rlike(pattern), F.regexp_extract(label, pattern, 1).cast("int"))
    part = F.regexp_extract(label, pattern, 2)
    month = F.when(part == "一季报", 3).when(part.isin("中报", "半年报"), 6).when(part == "三季报", 9).when(part == "年报", 12)
    return F.last_day(F.make_date(year, month, F.lit(1)))


def period_shape(period: Column) -> tuple[Column, Column]:
    """(report type, period basis) of a quarter end; NULL otherwise."""
    m, last = F.month(period), period == F.last_day(period)
    kind = F.when(last, F.when(m == 3, "q1").when(m == 6, "semiannual").when(m == 9, "q3").when(m == 12, "annual"))
    return kind, F.when(kind == "annual", "full_year").when(kind.isNotNull(), "ytd_cumulative")


def ceil_second(t: Column) -> Column:
    whole = F.date_trunc("second", t).cast("timestamp_ntz")
    return F.when(whole == t, t).otherwise(whole + F.make_dt_interval(secs=F.lit(1).cast("decimal(18,6)")))


def market_time(released: Column, vendor: Column, validated: Column, precise: Column) -> Column:
    """Historical availability: validated and precise only, the later of both clocks, whole seconds."""
    return F.when(validated & precise, F.greatest(ceil_second(released), ceil_second(vendor)))
