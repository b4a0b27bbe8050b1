"""Licence scan: a trained paragraph classifier, confirmed by templates. DataFrame functions only, no Python on executors.

Lines with a licence word are classified by multinomial logistic regression over their word unigrams and bigrams, as far as
templates have them; where a template runs over the line's borders, by the words of the template's place in the run of non-blank
lines. That a line does nothing but name a licence is one more feature. The classifier is trained on damaged copies of the
templates and of such names and, as the class ``unknown``, on grants under made-up names, on sentences that speak of licences
without granting one and on lines of a bounded sample of documents.

A prediction counts from a probability on that is calibrated for each family: of unknown rows kept for it, and of the rows of whole
families that a classifier has not been shown, at most one in a hundred reaches it. And the paragraph must hold most words of a
template of the family, and half of what tells that template from all other families and from the unknown rows.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import pick

UNKNOWN = "unknown"

# Notices of public licences: fixed values.
TEMPLATES = {
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "Distributed under the terms of the MIT license"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache 2.0 license",
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "you may not use this file except in compliance with the License"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-or-later",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "Licensed under the GPL version 2", "Released under the GNU GPL v3"],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-or-later", "Released under the LGPL version 3"],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only", "Released under the AGPL version 3"],
    "BSD": ["Licensed under the BSD 3-Clause License", "Released under the BSD license", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the 2-clause BSD license",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "EPL": ["Licensed under the Eclipse Public License, version 2.0", "SPDX-License-Identifier: EPL-2.0", "made available under the terms of the Eclipse Public License"],
    "ISC": ["Licensed under the ISC License", "SPDX-License-Identifier: ISC",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "CC-BY": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC0": ["Dedicated to the public domain under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"],
    "Proprietary": ["All rights reserved. No part of this publication may be reproduced without permission", "Proprietary and confidential, all rights reserved"],
}
# Sentences with licence words that grant nothing.
OTHER = [
    "The driver must carry a valid license at all times", "A fishing license costs ten dollars", "The license plate was hard to read", "Permission to enter was denied by the guard",
    "He asked the owner for permission to use the garden", "The warranty covers parts and work for two years", "Apache helicopters flew over the valley",
    "The Apache people lived in the southwest", "She studied physics at MIT for four years", "Researchers at MIT published a study", "The general public is welcome to the version shown here",
    "Mozilla announced a new browser version", "The museum is open to the public", "Copyright law is complicated", "The copyright dispute went to court", "A total eclipse of the sun was visible",
    "The licensed electrician came under the bridge", "Under the terms of the treaty the border moved", "Creative people share common traits", "The commons committee granted attribution of the work",
    "The software license agreement was signed by both parties", "The restaurant lost its liquor license", "This copy of the book is in the public library", "The distribution of free food was permitted",
    "Please read the license before you install the program", "Is this work licensed", "The version of the file is free of charge", "All rights and duties were reserved for the king",
]
# Grants whose licence is not on the list: sentences and names that nobody uses for one of the families.
GRANTS = [
    "Released under the {} License", "Licensed under the {} License", "Licensed under the {}, version 2", "Licensed under the {} License, version 2.0", "Released under the {} version 3",
    "Distributed under the terms of the {} license", "SPDX-License-Identifier: {}", "made available under the terms of the {} License", "{} License", "License: {}",
    "This work is licensed under the {} License, version 3", "This work is licensed under a {} 4.0 International License", "Licensed under {} 4.0",
    "You may obtain a copy of the License at http://www.{}.org/licenses/", "you may redistribute this file in compliance with the {} License", "Released under the {} license version 2.1",
    "This file is subject to the terms of the {} License, v. 2.0", "Dedicated to the public by {} 1.0", "Permission is granted to any person under the {} License",
    "you may not use this {} except in compliance with its license", "you may copy this program under the {} license as published by its authors",
]
MADE_UP = ["Acme", "Python Software Foundation", "Harbor Public", "Zeta", "Open Widget Community", "Example General", "Foobar Commons", "Artistic"]
# Names of licences as words, for lines that hold nothing else but words of FILLER, one of GRANT among them: fixed values.
NAMES = {
    "MIT": ["mit", "expat"],
    "Apache-2.0": ["apache-2.0", "apache 2.0", "apache 2", "apache v2", "apache v2.0", "apache2", "apache software 2.0"],
    "GPL": ["gpl", "gpl-2.0", "gpl-3.0", "gplv2", "gplv3", "gpl-2.0-only", "gpl-3.0-only", "gpl-2.0-or-later", "gpl-3.0-or-later", "gnu gpl", "gnu gplv2", "gnu gplv3", "gnu general public"],
    "LGPL": ["lgpl", "lgpl-2.1", "lgpl-3.0", "lgplv2.1", "lgplv3", "lgpl-2.1-only", "lgpl-3.0-only", "lgpl-2.1-or-later", "lgpl-3.0-or-later", "gnu lgpl", "gnu lesser general public"],
    "AGPL": ["agpl", "agpl-3.0", "agplv3", "agpl-3.0-only", "agpl-3.0-or-later", "gnu agpl", "gnu affero general public"],
    "BSD": ["bsd", "bsd-2-clause", "bsd-3-clause", "bsd 2-clause", "bsd 3-clause", "new bsd", "modified bsd", "simplified bsd", "revised bsd"],
    "MPL": ["mpl", "mpl-2.0", "mozilla public"],
    "EPL": ["epl", "epl-2.0", "eclipse public"],
    "ISC": ["isc"],
    "CC-BY": ["cc-by", "cc-by-4.0", "cc by", "creative commons attribution"],
    "CC-BY-SA": ["cc-by-sa", "cc-by-sa-4.0", "cc by-sa", "creative commons attribution-sharealike"],
    "CC-BY-NC": ["cc-by-nc", "cc-by-nc-4.0", "cc by-nc", "creative commons attribution-noncommercial"],
    "CC-BY-ND": ["cc-by-nd", "cc-by-nd-4.0", "cc by-nd", "creative commons attribution-noderivatives"],
    "CC0": ["cc0", "cc0-1.0"],
    "Unlicense": ["unlicense"],
}
GRANT = "license licence licensed licenses spdx-license-identifier unlicense cc0 cc0-1.0".split()
FILLER = GRANT + "the a this is see under terms of version v v2 v2.0 v2.1 v3 v3.0 1.0 2 2.0 2.1 3 3.0 4.0 or any later only project software file code work released distributed international universal".split()
LICENCE_WORD = r"(?i)licen[cs]e|copyright|copyleft|permission|permitted|spdx|public domain|rights reserved|apache|\bgnu\b|\ba?l?gpl|mozilla|creative commons|\bcc[ -]by|\bcc0|unencumbered|unlicense|(?-i:\bMIT\b)"  # in small letters a German word
ACROSS = LICENCE_WORD.replace("[ -]", r"[\s-]").replace(" ", r"\s+")  # also over the border of two lines
BLANK = r"\n[^A-Za-z0-9\n]*(?=\n)"
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
FEATURES = 1 << 14
LONGEST = max(len(re.findall(TOKEN, t.lower())) for texts in TEMPLATES.values() for t in texts)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def plain_words(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def _grams(w: Column) -> Column:
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    return F.array_intersect(F.concat(w, F.coalesce(pairs, F.array().cast("array<string>"))), _vocabulary())


def plain_grams(text: str) -> set[str]:
    w = plain_words(text)
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}


def strange_texts() -> list[str]:
    """Sentences of the class unknown: fixed ones, and every grant under every made-up name."""
    return OTHER + [g.format(n) for g in GRANTS for n in MADE_UP]


def telling() -> list[list[str]]:
    """For each template, its words and word pairs that neither another family nor an unknown sentence has."""
    strange = set().union(*map(plain_grams, strange_texts()))
    of = {f: set().union(*map(plain_grams, texts)) for f, texts in TEMPLATES.items()}
    out = []
    for f, texts in TEMPLATES.items():
        others = strange.union(*(g for k, g in of.items() if k != f))
        out += [sorted(plain_grams(t) - others) for t in texts]
    return out


def _vocabulary() -> Column:
    return _texts(sorted(set().union(*(plain_grams(t) for texts in TEMPLATES.values() for t in texts))))


def _texts(values: list[str]) -> Column:
    """A constant array that Spark folds to one literal; an array of literals would put each into the generated code."""
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def _templates() -> Column:
    """Distinct words of every template."""
    return F.transform(_texts([" ".join(dict.fromkeys(plain_words(t))) for texts in TEMPLATES.values() for t in texts]), lambda t: F.split(t, " "))


def _share(template: Column, w: Column) -> Column:
    return F.size(F.array_intersect(template, w)) / F.size(template)


def _declared(w: Column) -> Column:
    """The family that a line names, if it does nothing else; null for other lines. A feature and a template, no verdict."""
    names = F.zip_with(_texts([f for f, names in NAMES.items() for _ in names]), _texts([n for names in NAMES.values() for n in names]),
                       lambda f, n: F.struct(f.alias("family"), F.split(n, " ").alias("n")))
    alone = lambda n: (F.size(F.array_except(n, w)) == 0) & (F.size(F.array_except(w, F.concat(n, _texts(FILLER)))) == 0)
    found = F.filter(names, lambda x: alone(x["n"]))
    known = _texts(sorted({*FILLER, *(x for names in NAMES.values() for n in names for x in n.split())}))
    return F.when(F.arrays_overlap(w, _texts(GRANT)) & (F.size(F.array_except(w, known)) == 0), F.get(found, F.lit(0))["family"])


def licence_lines(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph, w, before and after of every line with a licence word, or the start of one that ends on the next line.

    ``w`` are the line's words, ``before`` and ``after`` those of the same run of non-blank lines, ``LONGEST`` at most: every
    line of a run has a word, so ``LONGEST`` lines hold them.
    """
    lines, n = F.split("text", "\n"), LONGEST
    texts = pick(docs, ["doc_id", "text"]).filter(F.col("text").rlike(ACROSS)).select("doc_id", lines.alias("lines"))
    line = lambda i: F.get("lines", i)
    split_word = lambda i: ~F.coalesce(line(i + 1), F.lit("")).rlike(LICENCE_WORD) & F.concat_ws("\n", line(i), line(i + 1)).rlike(ACROSS)
    at = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: line(i).rlike(LICENCE_WORD) | split_word(i))
    part = lambda begin, size: F.concat(F.lit("\n"), F.array_join(F.slice("lines", begin, size), "\n"), F.lit("\n"))
    found = F.transform(at, lambda i: F.struct(
        (i + 1).cast("long").alias("paragraph"), line(i).alias("line"),
        F.element_at(F.split(part(F.greatest(i + 1 - n, F.lit(1)), F.least(i, F.lit(n))), BLANK), -1).alias("before"),
        F.element_at(F.split(part(i + 2, F.lit(n)), BLANK), 1).alias("after")))
    rows = texts.select("doc_id", F.explode(found).alias("r")).select("doc_id", "r.paragraph", words(F.col("r.line")).alias("w"),
                                                                     words(F.col("r.before")).alias("before"), words(F.col("r.after")).alias("after"))
    return rows.withColumns({"before": F.slice("before", F.greatest(F.size("before") - n + 1, F.lit(1)), n), "after": F.slice("after", 1, n)})


def _unwrapped(rows: DataFrame, min_overlap: float) -> DataFrame:
    """``judged``: the words of the place of a template over the line's borders, if it has more of it than the line; else ``w``."""
    n, size = LONGEST, F.size("w")
    gap = F.array_repeat(F.lit(""), n)
    ends = F.when(size <= 2 * n, F.col("w")).otherwise(F.concat(F.slice("w", 1, n), gap, F.slice("w", size - n + 1, n)))
    rows = rows.withColumn("run", F.concat("before", ends, "after")).withColumn("first", F.size("before") + 1).withColumn("last", F.size("before") + F.size(ends))
    sized = F.zip_with(_templates(), _texts([str(len(plain_words(t))) for texts in TEMPLATES.values() for t in texts]),
                       lambda t, k: F.struct(t.alias("t"), k.cast("int").alias("k")))
    near = F.filter(sized, lambda x: _share(x["t"], F.col("run")) >= min_overlap)
    places = F.transform(near, lambda x: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("run") - x["k"] + 1, F.lit(1))),
        lambda i: F.struct(_share(x["t"], F.slice("run", i, x["k"])).alias("share"), (-i).alias("back"), x["k"].alias("k"))))
    own = F.array_max(F.transform(_templates(), lambda t: _share(t, F.col("w"))))
    rows = rows.withColumn("place", F.array_max(F.flatten(F.when(F.size("before") + F.size("after") > 0, places)))).withColumn("own", own)
    begin, end = -F.col("place.back"), F.col("place.k") - F.col("place.back") - 1
    across = (F.col("place.share") > F.col("own")) & (begin <= F.col("last")) & (end >= F.col("first"))
    return rows.withColumn("judged", F.when(across, F.slice("run", begin, F.col("place.k"))).otherwise(F.col("w")))


def _fixed(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """Fixed rows without a Python data source."""
    values = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("text")) for f, t in rows])
    return spark.range(1).select(F.explode(values).alias("r")).select("r.family", "r.text")


def training_rows(docs: DataFrame, max_docs: int, max_lines: int) -> DataFrame:
    """family and w (words): whole templates, names and copies with every third, fifth or seventh word missing; and unknown lines.

    The sample of lines is of at most ``max_docs`` documents (smallest md5 of the id) and ``max_lines`` lines (smallest md5).
    """
    spark = docs.sparkSession
    known = [(f, t) for f, texts in TEMPLATES.items() for t in texts]
    named = [(f, g.format(n)) for f, names in NAMES.items() for n in names for g in ("{} license", "license: {}", "licensed under the {} license")]
    fixed = _fixed(spark, known + named + [(UNKNOWN, t) for t in strange_texts()]).select("family", words(F.col("text")).alias("w"))
    holes = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(r).alias("r")) for m in (3, 5, 7) for r in range(m)]))
    damaged = fixed.select("family", "w", holes.alias("h")).select("family", F.filter("w", lambda _, i: F.pmod(i, F.col("h.m")) != F.col("h.r")).alias("w"))
    ids = docs.filter("doc_id is not null").select("doc_id").distinct().orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_docs)
    lines = docs.join(F.broadcast(ids), "doc_id", "left_semi").select(F.explode(F.split("text", "\n")).alias("line")).filter(~F.col("line").rlike(LICENCE_WORD))
    lines = lines.distinct().orderBy(F.md5("line"), "line").limit(max_lines).select(F.lit(UNKNOWN).alias("family"), words(F.col("line")).alias("w"))
    return fixed.unionAll(damaged).unionAll(lines)


def _vectors(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("declared", _declared(F.col("w"))).withColumn("grams", _grams(F.col("w")))
    rows = rows.withColumn("marks", F.when(F.col("declared").isNull(), F.col("grams")).otherwise(F.array_append("grams", F.concat(F.lit("names "), "declared"))))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="marks", outputCol="features").transform(rows)


def _best(rows: DataFrame) -> DataFrame:
    """family and probability of the most likely licence class; probability 0 where unknown is more likely than any."""
    names = F.array(*[F.lit(f) for f in TEMPLATES])
    p = vector_to_array("probability")
    out = rows.withColumn("p", p).withColumn("other", F.element_at("p", 1)).withColumn("p", F.slice("p", 2, len(TEMPLATES)))
    out = out.withColumn("top", F.array_max("p")).withColumn("best", F.element_at(names, F.array_position("p", F.col("top")).cast("int")))
    return out.withColumn("top", F.when(F.col("top") > F.col("other"), F.col("top")).otherwise(0.0))


FOLDS = 4  # families are left out by quarters


def train(docs: DataFrame, max_docs: int = 200, max_lines: int = 500) -> tuple[LogisticRegressionModel, dict[str, float]]:
    """The classifier and, for each family, the least probability that counts.

    Classifiers that have not seen a quarter of the families judge these; with the unknown rows kept for calibration they are
    strangers. A family's probability is the one that at most one in a hundred strangers reach, but none that more than a tenth of
    the family's own rows kept for calibration miss, and no less than a half.
    """
    families = [UNKNOWN, *TEMPLATES]
    code = F.create_map(*[F.lit(x) for i, f in enumerate(families) for x in (f, float(i))])
    fold = F.create_map(*[F.lit(x) for i, f in enumerate(families) for x in (f, i % FOLDS if i else -1)])
    rows = _vectors(training_rows(pick(docs, ["doc_id", "text"]), max_docs, max_lines)).withColumn("label", F.element_at(code, F.col("family")))
    rows = rows.withColumns({"tune": F.pmod(F.xxhash64("w"), F.lit(4)) == 0, "fold": F.element_at(fold, F.col("family"))}).coalesce(1).cache()  # some thousand rows

    def fit(shown: DataFrame) -> LogisticRegressionModel:
        return LogisticRegression(family="multinomial", regParam=0.002, maxIter=50, featuresCol="features", labelCol="label").fit(shown)

    strangers = None
    for k in range(FOLDS):
        judge = fit(rows.filter(~F.col("tune") & (F.col("fold") != k)))
        told = _best(judge.transform(rows.filter((F.col("fold") == k) | (F.col("tune") & (F.col("family") == UNKNOWN))))).select("best", "top")
        strangers = told if strangers is None else strangers.unionAll(told)
    counted = strangers.groupBy("best").agg(F.sort_array(F.collect_list("top"), asc=False).alias("top")).collect()  # of the training rows alone
    n = strangers.count()
    fitted = fit(rows.filter("not tune"))
    own = _best(fitted.transform(rows.filter("tune"))).filter("best = family")
    own = {r["family"]: r["low"] for r in own.groupBy("family").agg(F.percentile("top", F.lit(0.1)).alias("low")).collect()}
    least = {f: 0.5 for f in TEMPLATES}
    for r in counted:
        allowed = int(n * 0.01 / len(TEMPLATES))
        if len(r["top"]) > allowed:
            least[r["best"]] = max(0.5, min(r["top"][allowed], own.get(r["best"], 0.5)))
    rows.unpersist()
    return fitted, least


def scan(docs: DataFrame, model: LogisticRegressionModel, least: dict[str, float], min_overlap: float = 0.7, min_told: float = 0.5) -> DataFrame:
    """doc_id, paragraph, family, probability, overlap and confirmed of every line with a licence word.

    ``paragraph`` counts lines from 1. A notice that is wrapped over lines is told at each of its lines with a licence word.
    ``family`` is ``unknown`` below the family's ``least`` or where no template of it has ``min_overlap`` of its words and
    ``min_told`` of its ``telling`` ones in the line or notice; a line that only names a licence is a template of its own.
    Null, empty and other texts, and an empty table: no rows. Very long lines: scanned whole. Families of equal probability: the first of the
    list. Null ids and repeated rows: scanned like any row. Extra columns are ignored.
    """
    found = _unwrapped(licence_lines(docs), min_overlap).select("doc_id", "paragraph", F.col("judged").alias("w"))
    scored = _best(model.transform(_vectors(found)))
    owner = _texts([f for f, texts in TEMPLATES.items() for _ in texts])
    marks = F.transform(_texts(["\x1e".join(t) for t in telling()]), lambda t: F.split(t, "\x1e"))
    told = F.zip_with(owner, marks, lambda f, t: F.when(f == F.col("best"), F.size(F.array_intersect(t, F.col("grams"))) / F.size(t) >= min_told))
    shares = F.zip_with(_templates(), told, lambda t, ok: F.when(ok, _share(t, F.col("w"))))
    named = F.coalesce(F.col("declared") == F.col("best"), F.lit(False))
    scored = scored.withColumn("overlap", F.when(named, 1.0).otherwise(F.coalesce(F.array_max(shares), F.lit(0.0))))
    enough = F.element_at(F.create_map(*[F.lit(x) for f, v in least.items() for x in (f, v)]), F.col("best"))
    scored = scored.withColumn("confirmed", (F.col("top") >= enough) & (F.col("overlap") >= min_overlap))
    family = F.when(F.col("confirmed"), F.col("best")).otherwise(UNKNOWN)
    return scored.select("doc_id", "paragraph", family.alias("family"), F.col("top").alias("probability"), "overlap", "confirmed")
