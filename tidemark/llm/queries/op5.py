from __future__ import annotations

from tidemark.llm.common import documents
from tidemark.llm.parsing import fingerprints
from tidemark.llm.registry import query


@query("op5_consistent_parsing")
def op5(spark, folder):
    return fingerprints(documents(spark, folder))
