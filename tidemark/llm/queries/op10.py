from __future__ import annotations

from tidemark.llm import licences
from tidemark.llm.common import documents
from tidemark.llm.registry import query


@query("op10_licence_scan")
def op10(spark, folder):
    docs = documents(spark, folder)
    return licences.scan(docs, *licences.train(docs))
