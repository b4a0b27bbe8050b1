"""Exact nearest neighbours by cosine: a block matrix join with int8 tiles.

Rows with equal vectors are a class, which takes part once; only its ``k + 1`` smallest ids can appear in a result. Classes that are
asked for are dealt in query blocks, all classes in candidate blocks, and every query block meets every candidate block in one
task. The task quantises both to int8 and multiplies tiles; each product has a bound on its quantisation error, and only pairs that
can still be among a query's best are recomputed in double precision from the original vectors. Each query keeps a heap in
the task; the heaps of all tasks are merged by the query's class, and each query row leaves itself out.

A task holds one query block and streams its candidates, so its memory does not grow with the table. Every class is sent once
for each query block and every query once for each candidate block. No sample, no index: recall is 1.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pick
from tidemark.session import materialise

QUERY_BYTES = 32 << 20  # original vectors of a query block
LEAST_BLOCK = 8192  # candidates of a block, or as many as there are queries in one
TILE = 1024
SALTS = 16  # tasks over which the rows of one asked vector are spread
SLACK = 1e-6  # more than the rounding of the bounds in float32
LANES = 1024  # products of int8 vectors of so many components are whole numbers that float32 holds exactly


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, va, vb): rows that take part, with a 128-bit key of the vector.

    Null ids; vectors that are null, empty or zero; vectors with a null, infinite or not-a-number component take no part.
    """
    rows = pick(vectors, ["vec_id", "embedding"]).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    if dict(rows.dtypes)["embedding"] != "array<float>":
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~odd & F.exists("embedding", lambda x: x != 0))
    return rows.withColumns({"va": F.xxhash64("embedding"), "vb": F.xxhash64(F.lit(17), "embedding")})


class Block:
    """Vectors in rows: originals, lengths, int8 units as float32, their scales and the lengths of the quantisation errors."""

    def __init__(self, raw: np.ndarray):
        step = np.exp2(-np.frexp(np.abs(raw).max(axis=1).astype("float64"))[1])[:, None]  # a power of two: scaling is exact
        self.raw = raw.astype("float64") * step if raw.dtype == np.float64 else raw
        self.norm = np.sqrt(self._sum(np.square(self.raw, dtype="float64")))
        unit = self.raw / self.norm[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        whole = np.rint(unit / self.scale[:, None])
        self.error = np.sqrt(np.square(unit - whole * self.scale[:, None]).sum(axis=1))
        self.cells = whole.astype("int8")

    @staticmethod
    def _sum(x: np.ndarray) -> np.ndarray:
        """Row sums from left to right, the same for equal rows wherever they stand."""
        return np.cumsum(x, axis=1)[:, -1]

    def products(self, rows: slice, other: Block, columns: slice) -> np.ndarray:
        """Exact products of int8 vectors."""
        out = None
        for a in range(0, self.cells.shape[1], LANES):
            part = self.cells[rows, a:a + LANES].astype("float32") @ other.cells[columns, a:a + LANES].astype("float32").T
            out = part if out is None else out.astype("float64") + part
        return out

    def cosines(self, rows: np.ndarray, other: Block, columns: np.ndarray) -> np.ndarray:
        dot = self._sum(self.raw[rows].astype("float64") * other.raw[columns])
        return dot / (self.norm[rows] * other.norm[columns])


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def search(queries: Block, candidates: Block, first: np.ndarray, keys: np.ndarray, heaps: list[list], k: int) -> None:
    """Offer all candidates to the heaps of (score, -first, key, key), whose smallest entry is the worst of the best ``k``."""
    for a in range(0, len(candidates.norm), TILE):
        cols = slice(a, min(a + TILE, len(candidates.norm)))
        worst = candidates.error[cols].max()
        for b in range(0, len(queries.norm), TILE):
            rows = slice(b, min(b + TILE, len(queries.norm)))
            near = queries.products(rows, candidates, cols) * candidates.scale[cols].astype("float32")
            margin = (worst + queries.error[rows] * (1 + worst)) + SLACK  # of the cosine
            least = np.array([heaps[i][0][0] if len(heaps[i]) == k else -np.inf for i in range(rows.start, rows.stop)])
            if near.shape[1] > k:  # the k-th best of this tile by lower bounds
                least = np.maximum(least, np.partition(near, -k, axis=1)[:, -k] * queries.scale[rows] - margin)
            q, c = np.nonzero(near >= ((least - margin) / queries.scale[rows] - SLACK)[:, None])
            for at in range(0, len(q), 1 << 16):
                qi, ci = q[at:at + (1 << 16)] + b, c[at:at + (1 << 16)] + a
                score = queries.cosines(qi, candidates, ci)
                for i, s, j in zip(qi.tolist(), score.tolist(), ci.tolist()):
                    heap = heaps[i]
                    if len(heap) < k:
                        heapq.heappush(heap, (s, -int(first[j]), int(keys[j, 0]), int(keys[j, 1])))
                    elif s >= heap[0][0]:
                        heapq.heappushpop(heap, (s, -int(first[j]), int(keys[j, 0]), int(keys[j, 1])))


TILES = "qa long, qb long, score double, first long, va long, vb long"


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, raw, asked, queries, heaps = None, [], [], None, []

        def best() -> pa.RecordBatch:
            found = [(*asked[i], s, -f, a, b) for i, heap in enumerate(heaps) for s, f, a, b in heap]
            names = [f.split()[0] for f in TILES.split(", ")]
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in found], t) for j, t in enumerate(types)], names=names)

        for batch in batches:
            ids = np.stack([batch.column(j).to_numpy() for j in range(7)], axis=1)  # dims, query block, candidate block, role, va, vb, first
            edges = np.flatnonzero((ids[1:, :4] != ids[:-1, :4]).any(axis=1)) + 1
            for a, b in zip([0, *edges], [*edges, len(ids)]):
                if b == a:
                    continue
                if tile != tuple(ids[a, :3]):
                    if heaps:
                        yield best()
                    tile, raw, asked, queries, heaps = tuple(ids[a, :3]), [], [], None, []
                vectors = _matrix(batch.column(7).slice(a, b - a))
                if ids[a, 3] == 0:
                    raw.append(vectors)
                    asked += ids[a:b, 4:6].tolist()
                elif raw:
                    if queries is None:
                        queries, heaps = Block(np.concatenate(raw)), [[] for _ in asked]
                    search(queries, Block(vectors), ids[a:b, 6], ids[a:b, 4:6], heaps, k)
        if heaps:
            yield best()

    return run


def nearest(vectors: DataFrame, asks: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``asks`` the ``k`` rows of largest cosine, or all if there are fewer.

    ``asks`` is a condition on vec_id. Nearest first, ties to the smaller vec_id. A row is not its own neighbour, but another
    row of equal vector or id is; rows that ask repeatedly get the same answer each. Vectors are compared with those of equal length.
    Rows outside ``usable`` take no part. Empty table, or no other row: no rows. Extra columns are ignored.
    """
    rows = usable(vectors)
    own = Window.partitionBy("va", "vb").orderBy("vec_id")
    some = rows.withColumn("place", F.row_number().over(own)).filter(F.col("place") <= k + 1)  # limited before the exchange
    classes = some.groupBy("va", "vb").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding"))
    classes = materialise(classes.withColumn("dims", F.size("embedding").cast("long")), "vector-classes")
    queries = rows.filter(asks).select("va", "vb", F.col("vec_id").alias("query_id"))
    asked = materialise(classes.join(queries.select("va", "vb").distinct(), ["va", "vb"], "left_semi").select("va", "vb", "dims", "embedding"), "asked-classes")

    widest = asked.agg(F.max("dims")).first()[0]
    n, m = classes.count(), asked.count()
    width = 4 if dict(rows.dtypes)["embedding"] == "array<float>" else 8
    block = max(1, QUERY_BYTES // (width * max(widest or 1, 1)))
    query_blocks = max(1, -(-m // block))
    candidate_blocks = max(1, -(-n // max(LEAST_BLOCK, min(m, block))))
    key = F.xxhash64("va", "vb")
    deal = lambda count: F.pmod(key, F.lit(count)).alias("b")
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    left = asked.select("dims", deal(query_blocks).cast("long").alias("qblock"), every(candidate_blocks).alias("cblock"), F.lit(0).cast("long").alias("role"),
                        "va", "vb", F.lit(0).cast("long").alias("first"), "embedding")
    right = classes.select("dims", every(query_blocks).alias("qblock"), deal(candidate_blocks).cast("long").alias("cblock"), F.lit(1).cast("long").alias("role"),
                           "va", "vb", F.element_at("ids", 1).alias("first"), "embedding")
    tiles = left.unionAll(right).repartition(query_blocks * candidate_blocks, "dims", "qblock", "cblock")
    tiles = tiles.sortWithinPartitions("dims", "qblock", "cblock", "role").mapInArrow(_tiles(k + 1), TILES)

    place = F.row_number().over(Window.partitionBy("qa", "qb").orderBy(F.desc("score"), "first"))
    merged = tiles.withColumn("place", place).filter(F.col("place") <= k + 1)
    pairs = merged.join(classes.select("va", "vb", "ids"), ["va", "vb"]).select("qa", "qb", "score", F.explode("ids").alias("vec_id"))
    order = F.struct((-F.col("score")).alias("far"), "vec_id", "score")
    best = pairs.groupBy("qa", "qb").agg(F.slice(F.sort_array(F.collect_list(order)), 1, k + 1).alias("best"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    best = best.select(F.col("qa").alias("va"), F.col("qb").alias("vb"), "best", salts)
    answers = queries.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int")).join(best, ["va", "vb", "salt"])
    self_at = F.array_position("best.vec_id", F.col("query_id"))
    others = F.slice(F.filter("best", lambda x, i: i + 1 != self_at), 1, k)
    out = answers.select("query_id", F.posexplode(others).alias("rank", "near"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("near.vec_id").alias("vec_id"), F.col("near.score").alias("score"))
