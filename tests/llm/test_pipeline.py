"""Each stage of the pipeline against brute force on its own input."""

import collections

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_dedup import brute as components_of
from tests.llm.test_mixing import poisson, uniform
from tests.llm.test_packing import brute as best_fit
from tests.llm.test_secrets import brute_base

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows_of(df):
    return collections.Counter(tuple(r[c] for c in P.DOC_COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    odd = [(10_001, None, "en", "src0", None), (10_002, "", "en", None, 0), (10_003, "12 34 !!", None, "src0", 8), (None, "the of and that password=abc123def456 the", None, None, 42)]
    again = [tuple(r[c] for c in P.DOC_COLUMNS) for r in table.limit(2).collect()]
    return table.select(*P.DOC_COLUMNS).unionAll(spark.createDataFrame(odd + again, COLUMNS))


def test_language_stage_keeps_told_languages_only(spark, docs, folder):
    before, after = rows_of(docs), rows_of(P.language(spark, docs, folder))
    assert not after - before
    gone = {r[0] for r in before - after}
    assert {10_001, 10_002, 10_003} <= gone and len(gone) < 0.05 * len(before)


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs, folder):
    before, after = rows_of(docs), rows_of(P.near_duplicates(spark, docs, folder))
    root, _ = components_of([(r[0], r[1]) for r in before], 5)
    assert after == collections.Counter({r: 1 for r in before if r[0] is None or root[r[0]] == r[0]})


def test_secret_stage_leaves_no_pattern(spark, docs, folder):
    before, after = rows_of(docs), rows_of(P.redact_secrets(spark, docs, folder))
    assert sum(after.values()) == sum(before.values())
    assert not any(brute_base(r[1]) for r in after)
    clean = collections.Counter({r: n for r, n in before.items() if not brute_base(r[1])})
    assert not clean - after


def test_mixing_stage_repeats_by_source(spark, docs, folder):
    before, after = rows_of(docs), rows_of(P.mix_sources(spark, docs, folder))
    size = collections.Counter()
    for r, n in before.items():
        size[r[3]] += n * len(r[1] or "")
    total, weight = sum(size.values()), sum(v**0.5 for v in size.values())
    want = collections.Counter()
    for r, n in before.items():
        rate = total * size[r[3]] ** 0.5 / weight / size[r[3]] if size[r[3]] else 0
        want[r] = n * poisson(rate, uniform(1, r[0]))
    assert after == +want


def test_packing_stage_places_every_piece(spark, docs, folder):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for r, n in rows_of(docs).items():
        left, piece = len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1, 0
        while left > 0:
            want[r[0], piece, min(left, 2048)] += n
            left, piece = left - 2048, piece + 1
    out = P.pack_sequences(spark, docs, folder).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["length"]) for r in out) == want
    ends = collections.defaultdict(list)
    for r in out:
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in ends.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 2048
    assert len(ends) == len(best_fit([r["length"] for r in out], 2048))


def test_run_chains_the_stages(spark, folder):
    out = P.run(spark, folder)
    assert out.columns[:3] == ["doc_id", "piece", "start"] and out.count() > 50
    assert len(P.STAGES) == 5
