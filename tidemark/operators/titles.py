"""Event codes of announcement titles: provider codes first, then the first title rule that matches.

Every rule has required literals: whatever it matches contains one of them. They make an index from literal to rules; a title
looks up the rules whose literals it contains and tries the patterns of these alone, in rule order. All of it is one projection.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as TX
from tidemark.functions import title_rules as R
from tidemark.functions.title_rules import TitleRule

UNCLASSIFIED = "event.announcement.unclassified"
BUYBACK_CHANGE = "event.repurchase_capital.repurchase_change"
REPORT_KINDS = {"event.financial_results.annual_report": "annual", "event.financial_results.semiannual_report": "semiannual",
                "event.financial_results.quarterly_report": "quarterly"}
DOCUMENT_CODES = ("event.financial_results.earnings_forecast_published", "event.financial_results.earnings_flash_report", *REPORT_KINDS)


def required_literals(pattern: str) -> set[str]:
    """Literals of which every match of ``pattern`` contains one, as long and as few as possible.

    Patterns consist of letters, alternatives, plain groups, optional letters and groups, ``.*`` and the anchors ``^`` and ``$``.
    """
    found, end = _required(pattern, 0)
    if end != len(pattern):
        raise ValueError(f"unbalanced pattern {pattern!r}")
    return found


def _required(pattern: str, at: int) -> tuple[set[str], int]:
    found: set[str] = set()
    options: list[set[str]] = []
    run = ""

    def settle() -> set[str]:
        choices = options + ([{run}] if run else [])
        if not choices:
            raise ValueError(f"an alternative of {pattern!r} has no required literal")
        return max(choices, key=lambda c: (min(map(len, c)), -len(c)))

    while at < len(pattern) and pattern[at] != ")":
        letter, optional = pattern[at], pattern[at + 1:at + 2] == "?"
        if letter == "|":
            found |= settle()
            options, run, at = [], "", at + 1
            continue
        plain = letter not in "(.^$[]{}*+?\\"
        if plain and not optional:
            run, at = run + letter, at + 1
            continue
        if run:
            options.append({run})
            run = ""
        if plain:
            at += 2
        elif letter in "^$":
            at += 1
        elif pattern.startswith(".*", at):
            at += 2
        elif pattern.startswith("(?:", at):
            inner, at = _required(pattern, at + 3)
            at += 1
            if pattern[at:at + 1] == "?":
                at += 1
            else:
                options.append(inner)
        else:
            raise ValueError(f"{pattern!r} is no title pattern at {at}")
    return found | settle(), at


def told(title: str, rules: Sequence[TitleRule]) -> str | None:
    """Id of the rule that tells one normalised title, in plain Python; for the few samples of the rules themselves."""
    if re.search(R.NEGATED, title) or re.search(R.REVISED, title):
        return None
    hits = (r.id for r in rules if re.search(r.pattern, title) and not (r.excluded and re.search(r.excluded, title)))
    return next(hits, None)


def accepted(rules: Sequence[TitleRule]) -> tuple[TitleRule, ...]:
    """Rules with evidence: their sample is told by them and by no rule before, and is not told once it is revised or only rumoured."""
    return tuple(r for r in rules if r.sample and told(r.sample, rules) == r.id and told(f"{r.sample}的更正公告", rules) is None
                 and told(f"网传{r.sample}", rules) is None)


def normalised(title: Column) -> Column:
    """Compatibility form without white space."""
    return F.regexp_replace(TX.nfkc(title), r"(?U)\s+", "")


def _rule_of(title: Column, rules: Sequence[TitleRule]) -> Column:
    """Struct (id, code) of the first rule, or null."""
    index: dict[str, list[int]] = {}
    for n, r in enumerate(rules):
        for literal in required_literals(r.pattern):
            index.setdefault(literal, []).append(n)
    literals = F.array(*[F.struct(F.lit(k).alias("literal"), F.array(*map(F.lit, v)).alias("rules")) for k, v in sorted(index.items())])
    table = F.array(*[F.struct(*[F.lit(v).cast("string").alias(c) for c, v in (("id", r.id), ("code", r.code), ("pattern", r.pattern), ("excluded", r.excluded))])
                      for r in rules])
    near = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(literals, lambda x: F.contains(title, x["literal"])), lambda x: x["rules"]))))
    tried = F.transform(near, lambda n: F.get(table, n))
    hits = F.filter(tried, lambda r: F.regexp(title, r["pattern"]) & (r["excluded"].isNull() | ~F.regexp(title, r["excluded"])))
    return F.get(hits, F.lit(0))


def classified(df: DataFrame, title: str, columns: str | None = None, rules: Sequence[TitleRule] = R.ISSUER_TITLES) -> DataFrame:
    """``df`` with event_code, method (column_code, title_rule or unclassified) and rule_id.

    A title that denies or doubts is never classified. ``columns``, an array of provider codes, decides before the rules: its
    smallest known code, unless the title revises it, or names a report that is not its initial complete form. Rules without
    evidence (``accepted``) are left out. Null title: unclassified, unless a provider code tells it.
    """
    rules = accepted(rules)
    t = F.col("_title")
    named = F.lit(None).cast("string")
    if columns is not None:
        known = F.filter(F.array_sort(F.coalesce(F.col(columns), F.array().cast("array<string>"))), lambda c: c.isin(*R.COLUMN_CODES))
        named = F.get(known, F.lit(0))
    out = df.withColumn("_title", F.coalesce(normalised(F.col(title)), F.lit(""))).withColumn("_named", named)
    code = F.coalesce(*[F.when(F.col("_named") == k, F.lit(v)) for k, v in R.COLUMN_CODES.items()])
    revised = t.rlike(R.REVISED)
    own_revision = (code == BUYBACK_CHANGE) & t.rlike(R.REVISED_BUYBACK) & ~t.rlike(R.NOT_REVISED_BUYBACK)
    kind = F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in REPORT_KINDS.items()])
    whole = ~code.isin(*DOCUMENT_CODES) | (~t.rlike(TX.NOT_INITIAL) & (kind.isNull() | F.coalesce(TX.report_kind(t) == kind, F.lit(False))))
    blank = F.struct(F.lit(UNCLASSIFIED).alias("code"), F.lit("unclassified").alias("method"), F.lit(None).cast("string").alias("id"))
    by_column = F.struct(code.alias("code"), F.lit("column_code").alias("method"), F.concat(F.lit("column:"), F.col("_named")).alias("id"))
    first = _rule_of(t, rules)
    by_rule = F.struct(first["code"].alias("code"), F.lit("title_rule").alias("method"), first["id"].alias("id"))
    choice = (
        F.when(t.rlike(R.NEGATED), blank)
        .when(F.col("_named").isNotNull(), F.when((~revised | own_revision) & whole, by_column).otherwise(blank))
        .when(revised | first.isNull(), blank)
        .otherwise(by_rule)
    )
    out = out.withColumn("_told", choice)
    return out.select(*df.columns, F.col("_told.code").alias("event_code"), F.col("_told.method").alias("method"), F.col("_told.id").alias("rule_id"))
