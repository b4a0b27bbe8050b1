import re

import pytest

from tidemark.llm import licences as C
from tidemark.llm.queries.op10 import op10

PLANTED = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC", "This work is licensed under the GNU General Public License, version 3.": "GPL",
           "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}


@pytest.fixture(scope="module")
def model(spark, folder):
    return C.train(spark.read.parquet(f"{folder}/documents.parquet"))


def families(spark, model, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, family string")
    out = {}
    for r in C.scan(df, *model).collect():
        out.setdefault(r["doc_id"], []).append((r["paragraph"], r["family"]))
    return out


def test_query_finds_every_licence_line(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    want = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        for k, line in enumerate((r["text"] or "").split("\n"), 1):
            if line in PLANTED:
                want.add((r["doc_id"], k, PLANTED[line]))
    rows = op10(spark, folder).collect()
    assert {(r["doc_id"], r["paragraph"], r["family"]) for r in rows if r["confirmed"]} == want and len(want) > 5


def test_templates_and_damage(spark, model):
    texts = [t for ts in C.TEMPLATES.values() for t in ts]
    want = [f for f, ts in C.TEMPLATES.items() for _ in ts]
    got = families(spark, model, texts)
    hits = sum(got.get(i, [(1, None)])[0][1] == f for i, f in enumerate(want))
    assert hits >= 0.9 * len(texts)
    longer = families(spark, model, ["File parser. Copyright 2020 somebody. " + t + " and so on." for t in PLANTED])
    assert [longer[i][0][1] for i in range(4)] == list(PLANTED.values())


def test_other_sentences_are_unknown(spark, model):
    texts = ["Her nursing license expired last spring", "The MIT campus is near the river", "You need permission from the council to build", "Copyright terms differ between countries",
             "The licence fee rose by two pounds"]
    got = families(spark, model, texts)
    assert sorted(got) == list(range(5)) and all(f == C.UNKNOWN for rows in got.values() for _, f in rows)


def test_german_words_are_no_licence(spark, model):
    assert families(spark, model, ["Er kam mit dem Zug", "mit und ohne"]) == {}


def test_edge_rows(spark, model):
    line = "Released under the MIT License."
    df = spark.createDataFrame([(1, None), (2, ""), (3, "no such words"), (None, line), (4, f"a\n\n{line}\nx"), (4, f"a\n\n{line}\nx"), (5, "word " * 50_000 + line)], "doc_id bigint, text string")
    rows = sorted(((r["doc_id"] or 0, r["paragraph"], r["family"]) for r in C.scan(df, *model).collect()))
    assert rows == [(0, 1, "MIT"), (4, 3, "MIT"), (4, 3, "MIT"), (5, 1, "MIT")]
    empty = df.limit(0)
    assert C.scan(empty, *C.train(empty)).count() == 0


WRAPPED = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""),
    ("GPL", """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""),
    ("BSD", """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""),
    ("Apache-2.0", """ * you may not use this file
 * except in compliance
 * with the License."""),
    ("Proprietary", "Proprietary and confidential, all rights\nreserved"),
]


def test_wrapped_notices(spark, model):
    texts = [t for _, t in WRAPPED] + ["a b c\n\n" + t + "\n\nd e f" for _, t in WRAPPED] + ["word " * 300 + t.replace("\n", "\n\n") for _, t in WRAPPED[:1]]
    got = families(spark, model, texts)
    for i, (family, _) in enumerate(WRAPPED + WRAPPED):
        assert {f for _, f in got[i]} - {C.UNKNOWN} == {family}, texts[i]
    assert {f for _, f in got[10]} == {C.UNKNOWN}  # blank lines end a notice
    near = families(spark, model, ["The guard denied permission to enter\nReleased under the MIT License.\nA fishing license costs ten dollars"])
    assert near[0] == [(1, C.UNKNOWN), (2, "MIT"), (3, C.UNKNOWN)]


def test_short_declarations(spark, model):
    want = {"MIT License": "MIT", "License: Apache-2.0": "Apache-2.0", "# The MIT License": "MIT", "License: MIT": "MIT", "BSD 3-Clause License": "BSD", "GNU General Public License v3.0": "GPL",
            "Licence: LGPL-2.1": "LGPL", "Mozilla Public License 2.0": "MPL", "The Unlicense": "Unlicense", "License: CC-BY-SA-4.0": "CC-BY-SA",
            "MIT issued a license": C.UNKNOWN}
    got = families(spark, model, list(want))
    assert {t: got[i][0][1] for i, t in enumerate(want)} == want


def test_plan_has_no_python(spark, folder):
    plan = op10(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


STRANGE = [
    "Licensed under the Python Software Foundation License version 2", "Distributed under the terms of the Acme license", "You may obtain a copy of the License at http://example.org/foo",
    "Released under the Artistic License 2.0", "Licensed under the Zlib license", "Licensed under the Boost Software License, Version 1.0", "SPDX-License-Identifier: WTFPL",
    "This work is licensed under the Open Data Commons License, version 1", "Distributed under the terms of the European Union Public Licence", "PostgreSQL License",
    "License: OFL-1.1", "you may not use this program except in compliance with the Sleepycat license", "Released under the Microsoft Public License", "Dedicated to the public by the author",
]


def test_families_outside_the_list_are_unknown(spark, model):
    got = families(spark, model, STRANGE)
    assert {t: f for i, t in enumerate(STRANGE) for _, f in got.get(i, [])} == {t: C.UNKNOWN for i, t in enumerate(STRANGE) if i in got}


def test_held_out_families_are_not_taken_for_others(spark, model, monkeypatch):
    """Each family in turn is off the list: less than one in a hundred of its lines may be confirmed as another."""
    lines = [(f, t) for f, texts in C.TEMPLATES.items() for t in texts] + [(f, f"{n} license") for f, names in C.NAMES.items() for n in names]
    told = {}
    for off in ("GPL", "CC-BY", "BSD"):
        with monkeypatch.context() as m:
            m.setattr(C, "TEMPLATES", {f: t for f, t in C.TEMPLATES.items() if f != off})
            m.setattr(C, "NAMES", {f: t for f, t in C.NAMES.items() if f != off})
            texts = [t for f, t in lines if f == off]
            blind = C.train(spark.createDataFrame([(1, "some text without any of it")], "doc_id bigint, text string"))
            told[off] = [f for rows in families(spark, blind, texts).values() for _, f in rows if f != C.UNKNOWN]
    assert sum(map(len, told.values())) <= 0.01 * len(lines), told


def plain_scan(text):
    """Lines that hold a whole template or only name a licence, in plain Python."""
    out = set()
    for k, line in enumerate((text or "").split("\n"), 1):
        if re.search(C.LICENCE_WORD.replace("(?-i:", "(?:").replace("(?i)", ""), line, re.I):
            w = set(C.plain_words(line))
            out |= {(k, f) for f, texts in C.TEMPLATES.items() for t in texts if set(C.plain_words(t)) <= w and C.plain_grams(t) <= C.plain_grams(line)}
    return out


def test_whole_templates_in_texts_equal_plain_search(spark, model, folder):
    texts = [r["text"] for r in spark.read.parquet(folder.replace("sf0.001", "sf0.01") + "/documents.parquet").collect()]
    got = families(spark, model, texts)
    for i, t in enumerate(texts):
        found = plain_scan(t)
        assert {k for k, _ in found} == {k for k, f in got.get(i, []) if f != C.UNKNOWN} and all(f in {x for k, x in found if k == n} for n, f in got.get(i, []) if f != C.UNKNOWN)
