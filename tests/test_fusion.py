"""Fusion of observations against a plain Python reading of the same rules."""

import random
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F
from tidemark.operators import events as E

SCHEMA = "id int, grp int, rank int, instrument int, code string, fact string, occurred date, day date, available int, attrs map<string,string>"


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        attrs = {}
        for name, values in (("amount", ["1.50", "1.5", "2", "-0.0"]), ("who", ['"a"', '"b"', "null"]), ("flag", ["true", "true", "false"]), ("raw_x", ['"1"', '"2"']),
                             ("Provider", ['"p"', '"q"']), ("extractor_v", ["1", "2"])):
            if rng.random() < 0.3:
                attrs[name] = rng.choice(values)
        rows.append((i, rng.randrange(120), rng.randrange(3), rng.randrange(100) // 99, rng.choice(["c"] * 20 + ["d"]), rng.choice([None, None, "f"] + ["g"] * (i % 9 == 0)),
                     rng.choice([None, date(2024, 1, 1), date(2024, 1, 1 + i % 2)]), date(2024, 1, 1 + (i % 11 == 0)), rng.choice([None, 5, 7]), attrs or None))
    return rows


def same(v):
    return str(Decimal(v).normalize()) if v[0] in "-0123456789" else v


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    events, conflicts = {}, set()
    for g, items in groups.items():
        items.sort(key=lambda r: (r[2], r[0]))
        chosen = next((r for r in items if r[8] is not None), items[0])
        bad = set()
        facts = {r[5] for r in items if r[5]}
        for code, at in (("fact", 5), ("instrument", 3), ("code", 4), ("occurred", 6)):
            if len({r[at] for r in items if r[at] is not None}) > 1:
                bad.add((code, None))
        if len({r[7] for r in items}) > 1 and len(facts) != 1:
            bad.add(("day", None))
        attrs = dict(chosen[9] or {})
        said = {}
        for r in items:
            for n, v in (r[9] or {}).items():
                attrs.setdefault(n, v)
                said.setdefault(n, set()).add(same(v))
        bad |= {("attribute_conflict", n) for n, v in said.items() if len(v) > 1 and n in ("amount", "who", "flag")}
        fact = chosen[5] or next((r[5] for r in items if r[5]), None)
        coverage = "conflicted" if bad else "unavailable" if chosen[8] is None else "complete" if chosen[2] == 0 else "partial"
        events[g] = (chosen[0], None if bad else chosen[8], len(items), fact, coverage, attrs)
        conflicts |= {(g, *b) for b in bad}
    return events, conflicts


def test_fusion_equals_plain_reading(spark):
    rows = corpus(4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    events, conflicts = plain(rows)
    fields = {c: F.col(c) for c in ("fact", "instrument", "code", "occurred", "day")}
    found = E.critical_conflicts(df, ["grp"], fields, "fact", "day", "attrs")
    assert {tuple(r) for r in found.collect()} == conflicts and len({c[1] for c in conflicts}) == 6
    fused = E.fuse(df, ["grp"], "rank", "id", "available", ["fact"], found, attributes="attrs")
    got = {r["grp"]: (r["selected"], r["available_at"], r["sources"], r["fact"], r["coverage"], r["attrs"]) for r in fused.collect()}
    assert got == events
    sources = E.provenance(df, fused, ["grp"], "rank", "id", ["code"]).collect()
    assert len(sources) == len(rows) and {(r["grp"], r["id"]) for r in sources if r["selected"]} == {(g, e[0]) for g, e in events.items()}


def test_lookups_move_ids_only(spark):
    rows = [(1, 1, "c", 1, "t", "d", "f", "payload"), (2, 1, "c", 1, "t", "d", None, "payload")]
    df = spark.createDataFrame(rows, "id int, inst int, code string, day int, title string, document string, fact string, body string")
    args = (["inst", "code"], "fact", "document", "title", "day")
    slim, whole = E.assign_identity(df, *args, id="id"), E.assign_identity(df, *args)
    assert {(r["id"], r["identity"], r["body"]) for r in slim.collect()} == {(r["id"], r["identity"], r["body"]) for r in whole.collect()}
