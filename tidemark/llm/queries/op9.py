from __future__ import annotations

from tidemark.llm import langid
from tidemark.llm.common import documents
from tidemark.llm.registry import query


@query("op9_language_id")
def op9(spark, folder):
    docs = documents(spark, folder)
    model = langid.train(docs, ~langid.held_out())
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")
