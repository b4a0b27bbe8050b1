from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm.common import documents
from tidemark.llm.registry import query
from tidemark.llm.secrets import scan


def told(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def number(kind):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query("op2_secret_scan")
def op2(spark, folder):
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return scan(documents(spark, folder)).select(
        "doc_id", number("assign"), number("access"), number("hex"), F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"), number("guess"))
