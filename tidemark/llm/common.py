"""Shared helpers: reading tables, Arrow batches as byte arrays, words and hashes in numpy, seeded uniforms in SQL."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SLICE_BYTES = 4 << 20
WORD = r"[^\x20\x09-\x0D]+"

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def over_arrow(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, size: int = SLICE_BYTES) -> DataFrame:
    """Map slices of at most about ``size`` bytes of text; column 0 may be of any type, the last one is the text.

    Only the named columns reach Python. Numpy temporaries are bounded by the slice, or by one document that is longer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(columns) - 1, size):
                out = fn(part)
                if out is not None:
                    yield out
        give_back()

    return pick(df, columns).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if n == 0:
        return
    sizes = np.nan_to_num(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype("float64"))
    block = (np.cumsum(sizes) // size).astype("int64")
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), n]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; a null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype="int64")[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype="uint8") if body is not None else np.zeros(0, "uint8")
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return what a task has freed to the system: Python workers live on, and what they keep counts against the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def co_located(df: DataFrame, label: str, column: str) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by ``column``: joins on it move the other side only."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"{label}_{uuid.uuid4().hex}", scratch_path(spark, label)
    df.repartition(parts, column).write.format("parquet").bucketBy(parts, column).sortBy(column).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.scratch = path
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
        known = _POWERS.get(name)
        if known is None or len(known) < n:
            known = np.full(max(n, 1), base, dtype="uint64")
            known[0] = 1
            known = np.cumprod(known, dtype="uint64")
            if n <= 2 * SLICE_BYTES:
                _POWERS[name] = known
        out.append(known)
    return out[0], out[1]


def _table(fold_case: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype="uint64") * _U(0xD6E8FEB86659FD93))
    if fold_case:
        t[65:91] = t[97:123]
    t[[9, 10, 11, 12, 13, 32]] = 0
    return t


_FOLDED, _PLAIN = _table(True), _table(False)
_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts: byte ranges, rows and 64-bit hashes."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_bytes(column)
        inside = ~_BREAK[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        #: words before each row; row i has words first[i] to first[i + 1]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, fold_case: bool = True) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, "uint64")
        up, down = _powers(len(self.data))
        terms = (_FOLDED if fold_case else _PLAIN)[self.data] * up[:len(self.data)]
        return mix(np.add.reduceat(terms, self.starts) * down[self.starts])


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _U(0xC2B2AE3D27D4EB4F) + ((b << _U(23)) | (b >> _U(41))))


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the md5 of the parts, joined by ``|``; DuckDB: see ``UNIFORM_SQL``."""
    cols = [F.lit(str(p)) if isinstance(p, int) else F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 13), 16, 10).cast("double") / float(1 << 52)


UNIFORM_SQL = "(CAST('0x' || substr(md5(concat_ws('|', {})), 1, 13) AS BIGINT) / 4503599627370496.0)"


def pick(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the columns an operator needs, so that extra columns cannot clash.

    Columns whose names differ in case alone, or not at all, are told apart by their place: an exact match wins, the first of several.
    """
    columns = df.columns
    if len({c.lower() for c in columns}) == len(columns):
        return df.select(*[F.col(f"`{n}`") for n in names])
    lower = [c.lower() for c in columns]
    at = [columns.index(n) if n in columns else lower.index(n.lower()) for n in names]
    placed = df.toDF(*[f"_{i}" for i in range(len(columns))])
    return placed.select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names)])
