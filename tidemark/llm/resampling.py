"""Quality classifier by importance resampling.

Two generative models over hashed word unigrams and bigrams: one of target texts, one of all texts. A document's weight is the
log ratio of its probabilities; adding Gumbel noise and taking the top k samples k documents without replacement in proportion
to their weights. Both models are arrays of ``buckets`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Words, over_arrow, pair_hash, pick, slices, uniform
from tidemark.session import materialise

SCALE = 1_000_000  # of keys when they are ranked


def buckets_of(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every word and of every pair of neighbours in a text."""
    w = Words(column)
    h, row = w.hashes(), w.rows()
    inside = np.flatnonzero(row[1:] == row[:-1])
    pairs = pair_hash(h[inside], h[inside + 1])
    return (np.concatenate([h, pairs]) % np.uint64(buckets)).astype("int64"), np.concatenate([row, row[inside]])


def bucket_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, raw, target) over all texts; ``docs`` has text and is_target. Each task sends one row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), "int64")
        for batch in batches:
            for part in slices(batch, 1):
                bucket, row = buckets_of(part.column(1), buckets)
                total[0] += np.bincount(bucket, minlength=buckets)
                target = part.column(0).to_numpy(zero_copy_only=False).astype(bool)[row]
                total[1] += np.bincount(bucket[target], minlength=buckets)
        found = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(found), *[pa.array(t[found]) for t in total]], names=["bucket", "raw", "target"])

    return docs.select("is_target", "text").mapInArrow(run, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(raw: np.ndarray, target: np.ndarray, smoothing: float) -> np.ndarray:
    p = [(x + smoothing) / (x.sum() + smoothing * len(x)) for x in (target, raw)]
    return np.log(p[0]) - np.log(p[1])


def kth_largest(ranked: DataFrame, column: str, k: int) -> tuple[int, int] | None:
    """(value, rows above it) of the k-th largest value of a long column, by narrowing its range 4,096-fold in each pass."""
    ends = ranked.agg(F.min(column), F.max(column)).first()
    if ends[0] is None or k <= 0:
        return None
    low, high, above = int(ends[0]), int(ends[1]), 0
    while low < high:
        width = max(1, -(-(high - low + 1) // 4096))
        inside = ranked.filter(F.col(column).between(low, high)).groupBy(F.floor((F.col(column) - low) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        for r in sorted(inside.collect(), key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                low, high = low + int(r["bin"]) * width, min(high, low + (int(r["bin"]) + 1) * width - 1)
                break
            above += r["n"]
        else:
            return None
    return low, above


def resample(docs: DataFrame, targets: DataFrame, keep_fraction: float = 0.9, buckets: int = 10_000, max_targets: int = 20_000, smoothing: float = 1.0, seed: int = 3) -> DataFrame:
    """doc_id, n_features, log_weight, rank_key and kept of every document.

    ``targets`` has the doc_ids of target texts; at most ``max_targets`` of them, those with the smallest md5, fit the target
    model. Kept are the ``keep_fraction`` (rounded down) of all rows with the highest keys; ties go to smaller ids. Null or empty
    text: no features and weight 0. Null ids share one noise. Repeated rows are ranked each. Without target texts the weights
    are those of a flat target. Empty table: no rows. Extra columns are ignored.
    """
    docs = pick(docs, ["doc_id", "text"])
    chosen = pick(targets, ["doc_id"]).filter("doc_id is not null").distinct().orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_targets)
    marked = docs.join(F.broadcast(chosen.select("doc_id", F.lit(True).alias("is_target"))), "doc_id", "left")  # max_targets rows
    counts = bucket_counts(marked.withColumn("is_target", F.coalesce("is_target", F.lit(False))), buckets).toArrow()  # `buckets` rows
    raw, target = np.zeros((2, buckets))
    raw[counts["bucket"].to_numpy()], target[counts["bucket"].to_numpy()] = counts["raw"].to_numpy(), counts["target"].to_numpy()
    ratio = log_ratios(raw, target, smoothing)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bucket, row = buckets_of(batch.column(1), buckets)
        n = batch.num_rows
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.bincount(row, minlength=n)), pa.array(np.bincount(row, ratio[bucket], minlength=n))],
                                          names=["doc_id", "n_features", "log_weight"])

    scored = over_arrow(docs, ["doc_id", "text"], run, "doc_id bigint, n_features bigint, log_weight double")
    key = F.col("log_weight") + gumbel(uniform(F.lit(seed), F.col("doc_id")))
    scored = materialise(scored.withColumn("rank_key", F.round(key * SCALE).cast("long")), "weights")
    k = int(scored.count() * keep_fraction)
    cut = kth_largest(scored, "rank_key", k)
    if cut is None:
        return scored.withColumn("kept", F.lit(False))
    value, above = cut
    # rows with the very key of the k-th: in order of their ids
    ties = scored.filter(F.col("rank_key") == value).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    last, left = None, k - above
    for r in ties.orderBy(F.col("doc_id").asc_nulls_last()).toLocalIterator():
        left -= r["n"]
        if left < 0:
            break
        last = r["doc_id"]
    tie = (F.col("rank_key") == value) & (F.col("doc_id") <= F.lit(last)) if last is not None else F.lit(False)
    return scored.withColumn("kept", F.coalesce((F.col("rank_key") > value) | tie, F.lit(False)))


def gumbel(u: Column) -> Column:
    """Standard Gumbel noise of a uniform number; the half step keeps the logarithms finite."""
    return -F.log(-F.log(u + F.lit(0.5 / (1 << 52))))
