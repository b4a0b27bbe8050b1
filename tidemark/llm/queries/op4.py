from __future__ import annotations

from tidemark.llm.common import documents
from tidemark.llm.perplexity import quality
from tidemark.llm.registry import query


@query("op4_perplexity_bands")
def op4(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return quality(documents(spark, folder), labels=labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "word_log_perplexity", "order_log")
