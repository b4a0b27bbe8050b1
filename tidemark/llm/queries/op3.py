from __future__ import annotations

from tidemark.llm.common import documents
from tidemark.llm.registry import query
from tidemark.llm.resampling import resample


@query("op3_importance_resampling")
def op3(spark, folder):
    """Target: documents that are labelled as of good quality."""
    targets = spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1").select("doc_id")
    return resample(documents(spark, folder), targets, keep_fraction=0.9)
