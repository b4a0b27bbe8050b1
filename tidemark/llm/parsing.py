"""Document fingerprints by locally consistent parsing.

A level parses a sequence of symbols into phrases: runs of equal symbols become one symbol; deterministic coin tossing gives
each symbol a label below 6 that depends on it and a few symbols to its left (the lowest bit in which it differs from its
neighbour, and that bit, four times over); phrases begin where labels have a local maximum. A phrase's name is a hash of its
symbols, and names are the symbols of the next level. So equal substrings get equal phrases except near their ends, whatever
their offsets. A fingerprint is a minwise sketch of the names of level ``LEVELS`` (about twelve bytes of text each).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import _powers, mix, pick, slices, text_bytes
from tidemark.session import materialise

LEVELS = 2
SIZE = 96  # bytes of a fingerprint
BLOCK = 256  # ids that are parsed together
_U = np.uint64
_ODD = mix(np.arange(101, 101 + SIZE, dtype="uint64")) | _U(1)
_BYTE = mix(np.arange(7001, 7257, dtype="uint64"))


def _toss(n: int) -> np.ndarray:
    """Label of symbol a after symbol b, for symbols below n."""
    a, b = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    x = a ^ b
    low = np.bitwise_count(((x & -x) - 1).astype("uint16"))
    return np.where(x == 0, 0, 2 * low + ((a >> np.minimum(low, 15)) & 1)).astype("uint8").reshape(-1)


_TOSS = {n: _toss(n) for n in (8, 16, 128, 256)}


def _labels(symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Labels below 6 of symbols that differ from their left neighbours; a first symbol is compared with itself ^ 1."""

    def before(x: np.ndarray) -> np.ndarray:
        p = np.empty_like(x)
        p[1:] = x[:-1]
        p[begins] = x[begins] ^ x.dtype.type(1)
        return p

    if symbols.dtype == np.uint8:
        x = _TOSS[256][symbols.astype("int32") << 8 | before(symbols)]
    else:
        d = symbols ^ before(symbols)
        low = np.bitwise_count((d & (~d + _U(1))) - _U(1)).astype("uint64")
        x = (_U(2) * low + ((symbols >> low) & _U(1))).astype("uint8")
        x = _TOSS[128][x.astype("int32") << 7 | before(x)]
    for n in (16, 8):
        x = _TOSS[n][x.astype("int32") * n | before(x)]
    return x


def parse(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the phrases of one level, the offsets of the texts among them, and where each phrase begins."""
    if not len(symbols):
        return np.zeros(0, "uint64"), np.zeros_like(offsets), np.zeros(0, "int64")
    text_begins = offsets[:-1][np.diff(offsets) > 0]
    keep = np.ones(len(symbols), bool)
    keep[1:] = symbols[1:] != symbols[:-1]
    keep[text_begins] = True
    at = np.flatnonzero(keep)
    run = np.diff(at, append=len(symbols)).astype("uint64")
    own = symbols[at]
    value = (_BYTE[own] if own.dtype == np.uint8 else own) + (run - _U(1)) * _U(0xD1342543DE82EF95)
    first = np.searchsorted(at, offsets)
    begins = np.searchsorted(at, text_begins)
    label = _labels(own, begins)
    start = np.zeros(len(at), bool)
    start[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    start[begins[begins > 0] - 1] = False  # the last symbol of a text has no right neighbour
    start[begins] = True
    cut = np.flatnonzero(start)
    up, down = _powers(len(at))
    names = mix(np.add.reduceat(value * up[:len(at)], cut) * down[cut])
    return names, np.searchsorted(cut, first), at[cut]


def sketch(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of whole texts, ``SIZE`` bytes each, and which texts are not empty."""
    data, offsets = text_bytes(column)
    names = data
    for _ in range(LEVELS):
        names, offsets, _ = parse(names, offsets)
    full = np.diff(offsets) > 0
    out = np.zeros((len(offsets) - 1, SIZE), "uint8")
    for k in range(SIZE if full.any() else 0):
        out[full, k] = np.minimum.reduceat(names * _ODD[k], offsets[:-1][full]) >> _U(40) & _U(255)
    return out, full


def likeness(a: np.ndarray, a_full: np.ndarray, b: np.ndarray, b_full: np.ndarray) -> np.ndarray:
    """Estimated share of common phrase names: 1 for two empty texts, 0 for an empty and another one."""
    equal = np.count_nonzero(a == b, axis=1) / SIZE
    share = np.clip((equal - 1 / 256) / (1 - 1 / 256), 0, 1)
    return np.where(a_full & b_full, share, np.where(a_full == b_full, 1.0, 0.0))


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def compare_next(ids: list, texts: list[str], following: list[str | None]) -> list[pa.Array]:
    """Columns of ``RESULT`` for texts and the texts that follow them (None: no next text, likeness 0)."""
    edited = []
    for own, other in zip(texts, following):
        k = len(own) // 4
        edited.append(own[:len(own) - k] + (other or "")[:k])
    prints = [sketch(pa.array(x, pa.large_string())) for x in (texts, edited, following)]
    hexed = [pa.array([r.tobytes().hex() if f else "" for r, f in zip(*p)], pa.string()) for p in prints[:2]]
    near = [likeness(*prints[0], *p) for p in prints[1:]]
    near[1] = np.where([x is None for x in following], 0.0, near[1])
    shas = pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string())
    return [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), shas, *hexed, *map(pa.array, near)]


def _blocks(docs: DataFrame) -> DataFrame:
    """Results of all documents whose next one is in their block of ids, and the texts at the borders of blocks.

    ``role``: 0 a result, 1 the first text of a block, 2 the last one.
    """

    def bordering(rows: list[tuple[int, int, str, int]]) -> pa.RecordBatch:
        block, ids, texts, role = zip(*rows)
        blank = [pa.nulls(len(rows), t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(role, pa.int32()), pa.array(block, pa.int64()), pa.array(texts, pa.string()), pa.array(ids, pa.int64()), *blank],
                                          names=["role", "block", "text", *NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # block, id and text of the row before
        for batch in batches:
            for part in slices(batch, 2):
                rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), [t or "" for t in part.column(2).to_pylist()]))
                rows = rows if last is None else [last, *rows]
                border = [(*rows[0], 1)] if last is None else []
                pairs = []
                for own, other in zip(rows, rows[1:]):
                    if own[0] == other[0]:
                        pairs.append((own, other))
                    else:
                        border += [(*own, 2), (*other, 1)]
                last = rows[-1]
                if border:
                    yield bordering(border)
                if pairs:
                    n = len(pairs)
                    columns = compare_next([p[0][1] for p in pairs], [p[0][2] for p in pairs], [p[1][2] for p in pairs])
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, "int32")), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), *columns],
                                                     names=["role", "block", "text", *NAMES])
        if last is not None:
            yield bordering([(*last, 2)])

    block = F.expr(f"doc_id div {BLOCK}").alias("block")
    dealt = docs.filter("doc_id is not null").select(block, "doc_id", "text").repartition("block").sortWithinPartitions("block", "doc_id", "text")
    return dealt.mapInArrow(run, f"role int, block bigint, text string, {RESULT}")


def _next_block(blocks: DataFrame) -> DataFrame:
    """(block, following): the next block in use, after the last the first; one row for 1,024 blocks passes through one task."""
    outer = blocks.select("block", F.expr("block div 1024").alias("outer"))
    least = outer.groupBy("outer").agg(F.min("block").alias("least"))
    first = least.agg(F.min("least").alias("first"))
    after = least.withColumn("after", F.expr("lead(least) over (order by outer)")).join(F.broadcast(first)).select("outer", F.coalesce("after", "first").alias("after"))
    inner = outer.withColumn("inner", F.expr("lead(block) over (partition by outer order by block)"))
    return inner.join(after, "outer").select("block", F.coalesce("inner", "after").alias("following"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint each document and its edited text; see the columns in ``RESULT``.

    The edited text has its last quarter (whole code points, rounded down) replaced by as many code points of the next document,
    in ascending order of doc_id, then text; after the last comes the first. Null text: empty. An empty text has an empty
    fingerprint. Null id: no next document, so the quarter is cut off and near_next is 0. Repeated rows follow one another.
    Empty table: no rows. Extra columns are ignored.
    """
    docs = pick(docs, ["doc_id", "text"])
    found = materialise(_blocks(docs), "blocks")
    border = found.filter("role > 0").select("role", "block", "doc_id", "text")
    heads = border.filter("role = 1").select(F.col("block").alias("following"), F.col("text").alias("next_text"))
    ends = border.filter("role = 2").select("block", "doc_id", "text").join(_next_block(border.filter("role = 1").select("block")), "block")
    lone = docs.filter("doc_id is null").select("doc_id", "text", F.lit(None).cast("string").alias("next_text"))
    pairs = ends.join(heads, "following").select("doc_id", "text", "next_text").unionAll(lone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                ids, texts, following = (c.to_pylist() for c in part.columns)
                yield pa.RecordBatch.from_arrays(compare_next(ids, [t or "" for t in texts], following), names=NAMES)

    return found.filter("role = 0").select(*NAMES).unionAll(pairs.mapInArrow(run, RESULT))
