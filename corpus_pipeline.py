"""Corpus pipeline over ``documents``: each stage works on all rows that its predecessor kept.

Every stage but the last returns the columns of documents; the last returns the places of token pieces in sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import dedup, langid, mixing, packing, secrets
from tidemark.llm.common import DOC_COLUMNS, pick
from tidemark.session import materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with calibrated confidence; the others go."""
    return langid.accepted(docs, langid.train(docs, F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id (five-word shingles, similarity 0.8).

    Documents without words or without an id stay; of rows that are equal in id and text one stays.
    """
    docs = pick(docs, DOC_COLUMNS)
    kept = dedup.near_duplicates(docs, width=5, similarity=0.8).filter("kept and doc_id is not null")
    ids = materialise(kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "kept-ids")
    stay = docs.join(ids.select("doc_id").hint("merge"), "doc_id", "left_semi")
    if ids.filter("n > 1").head(1):
        stay = stay.dropDuplicates(["doc_id", "text"])
    return stay.unionAll(docs.filter("doc_id is null")).select(*DOC_COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated at their source's rate, half-way between the sources' own sizes and equal shares, and shuffled."""
    return mixing.mix(docs, exponent=0.5, epochs=1.0, seed=1).select(*DOC_COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("secret_scan", redact_secrets), ("source_mix", mix_sources), ("best_fit_packing", pack_sequences)]
ORACLE_SQL = None  # the classifier and the tokenizer are beyond SQL; tests compare each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
