"""Counts of hashed keys over a whole corpus, asked for and answered in compressed columns.

Texts are cut into chunks of some million words. A chunk asks for the corpus counts of its distinct keys: it sends, for each
range of hashes, its sorted keys and own counts; the task of a range adds them up and answers each chunk in the order asked.
A key stands once in a request however often it occurs, so a key that holds a third of all tokens weighs no more than others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64


def squeeze(x: np.ndarray) -> bytes:
    """Bytes of an integer array, plane by plane, compressed."""
    x = np.ascontiguousarray(x)
    planes = x.view("uint8").reshape(len(x), x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(b: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), "uint8")
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1)


def squeeze_sorted(x: np.ndarray) -> bytes:
    return squeeze(np.diff(x, prepend=_U(0)))


def expand_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(expand(b, "uint64"), dtype="uint64")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one: a row holds a whole chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}


REQUEST = "range int, chunk bigint, keys binary, first binary, second binary"
ANSWER = "chunk bigint, range int, first binary, second binary, distinct bigint, total bigint"


def requests(chunks: DataFrame, columns: list[str], keys: Callable[[dict], tuple[np.ndarray, np.ndarray, np.ndarray]], ranges: int) -> DataFrame:
    """Rows of ``REQUEST``; ``keys`` gives the sorted distinct hashes of a chunk and two counts of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            key, first, second = keys(row)
            part = range_of(key, ranges)
            edge = np.searchsorted(part, np.arange(ranges + 1))
            rows = [(i, row["chunk"], squeeze_sorted(key[a:b]), squeeze(first[a:b].astype("uint32")), squeeze(second[a:b].astype("uint32")))
                    for i, (a, b) in enumerate(zip(edge, edge[1:])) if b > a]
            if rows:
                types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["range", "chunk", "keys", "first", "second"])

    return chunks.select("chunk", *columns).mapInArrow(run, REQUEST)


def range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    return ((key >> _U(32)) * _U(ranges) >> _U(32)).astype("int64")


def answers(asked: DataFrame) -> DataFrame:
    """Rows of ``ANSWER``: corpus counts in the order of each request; the first row of a range holds its distinct keys and total."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        keys = [expand_sorted(b) for b in pdf["keys"]]
        unique, at = np.unique(np.concatenate(keys), return_inverse=True)
        out, edge = {}, np.cumsum([len(k) for k in keys])[:-1]
        sums = [np.bincount(at, np.concatenate([expand(b, "uint32") for b in pdf[c]]), minlength=len(unique)).astype("uint64") for c in ("first", "second")]
        for c, s in zip(("first", "second"), sums):
            out[c] = [squeeze(x) for x in np.split(s[at], edge)]
        seen = sums[0] + sums[1] > 0
        lead = np.arange(len(pdf)) == 0
        return pd.DataFrame({"chunk": pdf["chunk"].to_numpy(), "range": pdf["range"].to_numpy(), **out,
                             "distinct": np.where(lead, seen.sum(), 0), "total": np.where(lead, (sums[0] + sums[1]).sum().astype("int64"), 0)})

    return asked.groupBy("range").applyInPandas(run, ANSWER)


def gathered(answered: DataFrame, name: str) -> DataFrame:
    """One row for each chunk with all its answers, as many as there are ranges."""
    return answered.groupBy("chunk").agg(F.collect_list(F.struct("range", "first", "second")).alias(name))


def aligned(parts: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a chunk's sorted keys from its answers."""
    parts = sorted(parts, key=lambda p: p["range"])
    return tuple(np.concatenate([np.zeros(0, "uint64"), *[expand(p[c], "uint64") for p in parts]]).astype("int64") for c in ("first", "second"))
