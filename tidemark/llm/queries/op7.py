from __future__ import annotations

from tidemark.llm.common import documents
from tidemark.llm.interpolation import language_model_scores
from tidemark.llm.registry import query


@query("op7_deleted_interpolation")
def op7(spark, folder):
    return language_model_scores(documents(spark, folder))
