"""Mixing sources to target weights by Poisson replication.

A source's rate is its share of the output over its share of the input. A document is repeated as often as the Poisson
distribution with that mean says for its uniform number, a hash of the seed and its id, so a run can be repeated and a document
keeps its number whatever partition it is in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import DOC_COLUMNS, pick, uniform
from tidemark.session import materialise

BROADCAST_SOURCES = 10_000
SALTS = 64


def _source() -> Column:
    """Null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None, exponent: float, epochs: float) -> DataFrame:
    """(key, rate): mean repetitions of each source's documents.

    Sizes are code points. The output has ``epochs`` times the size of the input; a source's share of it is its weight, or,
    without weights, in proportion to its size to the power ``exponent``. A source without a weight gets none.
    """
    sizes = docs.groupBy(_source().alias("key")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("size", F.lit(exponent)))
    else:
        named = {("-" if k is None else f"={k}"): float(v) for k, v in weights.items()}
        table = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
        sizes = sizes.withColumn("weight", F.coalesce(F.try_element_at(table, F.col("key")), F.lit(0.0)))
    sizes = materialise(sizes, "source-sizes")
    total = sizes.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    if not total["size"] or not total["weight"]:
        return sizes.select("key", F.lit(0.0).alias("rate"))
    share = F.col("weight") / F.lit(total["weight"])
    return sizes.select("key", F.when(F.col("size") > 0, F.lit(epochs * total["size"]) * share / F.col("size")).otherwise(0.0).alias("rate"))


def poisson_steps(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, 2, ... up to far beyond what 52 bits can tell from 1; empty for rate 0.

    Logarithms keep large rates from underflowing.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("steps"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(rate / k)
        total = acc["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"), F.concat(acc["steps"], F.array(total)).alias("steps"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step)["steps"]).otherwise(F.array().cast("array<double>"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, exponent: float = 0.5, epochs: float = 1.0, seed: int = 1) -> DataFrame:
    """Documents with ``copy`` (from 0) and ``shuffle_key``, in a global shuffle.

    Rows go to partitions by a hash of their key and are sorted by it there: an order that is uniform over the whole output and
    takes one exchange. Null text has size 0 and is repeated at its source's rate; a source of empty texts only has rate 0. Null
    source: a source of its own. Null ids share one uniform number; repeated rows have the same number, so they are repeated
    alike, with equal keys. Empty table: no rows. Extra columns are dropped.
    """
    docs = pick(docs, DOC_COLUMNS)
    rates = source_rates(docs, weights, exponent, epochs).select("key", poisson_steps(F.col("rate")).alias("steps"))
    rates = materialise(rates, "source-steps")
    keyed = docs.withColumn("key", _source())
    few = rates.agg(F.count(F.lit(1)), F.sum(F.size("steps"))).first()
    if few[0] <= BROADCAST_SOURCES and (few[1] or 0) <= 100 * BROADCAST_SOURCES:  # at most some MB
        keyed = keyed.join(F.broadcast(rates), "key")
    else:  # one source may hold most rows: deal each over SALTS tasks
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    u = uniform(F.lit(seed), F.col("doc_id"))
    copies = keyed.withColumn("u", u).withColumn("n", F.size(F.filter("steps", lambda s: s <= F.col("u"))))
    copies = copies.filter("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}o"), F.col("doc_id").cast("string"), F.col("copy").cast("string")))
    out = copies.withColumn("shuffle_key", key).select(*DOC_COLUMNS, "copy", "shuffle_key")
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
