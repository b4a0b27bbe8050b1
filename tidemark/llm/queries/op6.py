from __future__ import annotations

import public_tokenizers

from tidemark.llm.common import documents
from tidemark.llm.packing import pack
from tidemark.llm.registry import query


@query("op6_best_fit_packing")
def op6(spark, folder):
    return pack(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"), 2048)
