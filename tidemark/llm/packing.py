"""Best-fit decreasing packing of tokenised documents into sequences.

Pieces have whole lengths of at most ``capacity``, so best-fit decreasing over all pieces of the corpus needs no more than the
number of pieces of each length: ``plan_bins`` places whole length classes, longest first, each into the tightest bins that are
open, found in a segment tree over remaining capacities. The plan is a list of moves (which ranks of a length go to which bins);
its size depends on the capacity alone. Spark numbers the pieces of each length and looks their moves up, so no bin and no
piece passes through the driver.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import give_back, pick, slices, text_bytes
from tidemark.session import materialise

SLICE = 2 << 20  # bytes of text at a time
CACHE_WORDS = 400_000
_MARK = "^"
_LOWER = np.arange(256, dtype="uint8")
_LOWER[65:91] += 32
_LOWER[[9, 10, 13]] = 32
_LETTER, _MARKS = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[97:123] = True
_MARKS[[i for i in range(33, 127) if not chr(i).isalnum() and i != 39]] = True  # all ASCII punctuation but the apostrophe


class WordTokenizer:
    """Ids of whole texts from ids of their words.

    The tokenizer cuts texts at white space and never joins across it, so each distinct word of a batch is encoded once; a
    letter followed by ASCII punctuation is a cut as well, which leaves fewer distinct words. Texts with ``<|`` (perhaps a
    special token) and words with the mark are encoded on their own. Words met before are looked up as Arrow columns, so only
    new ones become Python strings; of more than ``CACHE_WORDS`` the half met in most batches stays.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids[0]
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.met = np.zeros(0, "int32")  # batches that hold the word
        self.pool, self.at = np.zeros(0, "<u4"), np.zeros(1, "int64")  # ids of word i: pool[at[i]:at[i + 1]]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encoded(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of words without white space, end to end, and how many each word has."""
        ids, sizes = [], []
        for i in range(0, len(words), 20_000):
            chunk = words[i:i + 20_000]
            lines = [f" {_MARK} ".join(chunk[j:j + 200]) + f" {_MARK}" for j in range(0, len(chunk), 200)]
            found = np.concatenate(self._plain(lines))
            ends = found == self.mark
            ids.append(found[~ends])
            sizes.append(np.diff(np.flatnonzero(ends), prepend=-1) - 1)
        return ids, sizes

    def _trim(self) -> None:
        if len(self.words) <= CACHE_WORDS:
            return
        keep = np.sort(np.argsort(-self.met, kind="stable")[:CACHE_WORDS // 2])
        sizes = np.diff(self.at)
        self.pool = _spans(self.pool, self.at[keep], sizes[keep])
        self.at = np.concatenate([[0], np.cumsum(sizes[keep])])
        self.words, self.met = self.words.take(pa.array(keep)), self.met[keep]

    def _places(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words in the cache; new ones are encoded and added."""
        self._trim()
        place = pc.index_in(words, value_set=self.words)
        fresh = words.filter(pc.is_null(place))
        place = pc.fill_null(place, -1).to_numpy().astype("int64")
        if len(fresh):
            marked = pc.match_substring(fresh, _MARK)
            fresh, alone = fresh.filter(pc.invert(marked)), fresh.filter(marked)
            own = self._plain(alone.to_pylist())
            ids, sizes = self._encoded(fresh.to_pylist())
            self.pool = np.concatenate([self.pool, *ids, *own])
            sizes = np.concatenate([np.diff(self.at), *sizes, [len(x) for x in own]]).astype("int64")
            self.at = np.concatenate([[0], np.cumsum(sizes)])
            new, marked, n = np.flatnonzero(place < 0), marked.to_numpy(zero_copy_only=False), len(self.words)
            place[np.concatenate([new[~marked], new[marked]])] = np.arange(n, n + len(new))
            self.words = pa.concat_arrays([self.words, fresh, alone])
            self.met = np.concatenate([self.met, np.zeros(len(new), "int32")])
        self.met[place] += 1
        return place

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 offsets of the rows; null counts as empty."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        special = pc.match_substring(column, "<|").to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(special), pa.scalar("", pa.large_string()), column)
        parts = pc.split_pattern(_cut(plain), " ")
        coded = parts.flatten().dictionary_encode()
        place = self._places(coded.dictionary)
        sizes = np.diff(self.at)[place]
        index = coded.indices.to_numpy(zero_copy_only=False)
        n_words = np.diff(parts.offsets.to_numpy())
        size = sizes[index]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = _spans(self.pool, self.at[place][index], size)
        row_at = ends[np.concatenate([[0], np.cumsum(n_words)])]
        if special.any():
            rows = [ids[a:b] for a, b in zip(row_at, row_at[1:])]
            where = np.flatnonzero(special)
            for i, own in zip(where, self._plain(column.take(pa.array(where)).to_pylist())):
                rows[i] = own
            ids = np.concatenate(rows)
            row_at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return ids, row_at


def _spans(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``pool[start:start + size]`` of all spans, end to end."""
    upto = np.cumsum(size)
    return pool[np.repeat(start - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]


def _cut(texts: pa.Array) -> pa.Array:
    """Texts, lower-cased in ASCII, with a space for each line break and tab and between a letter and ASCII punctuation after it."""
    data, offsets = text_bytes(texts)
    data = _LOWER[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = _LETTER[data[:-1]] & _MARKS[data[1:]]
    cut[offsets] = False
    moved = np.arange(len(data) + 1) + np.cumsum(cut)
    out = np.full(moved[-1], 32, dtype="uint8")
    out[moved[:-1]] = data
    offsets = moved[offsets]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(out))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Token pieces: doc_id, piece, start, length, ids_crc32 (and ids), and a number within (part, length).

    A document is its ids and then id 0; a longer one is cut every ``capacity`` ids. A null or empty text is the one id 0.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype="int64")
        for batch in batches:
            for rows in slices(batch, 1, SLICE):
                ids, at = tok.encode(rows.column(1))
                sizes = np.diff(at) + 1  # with the final 0
                flat = np.zeros(len(ids) + len(sizes), dtype="<u4")
                keep = np.ones(len(flat), bool)
                keep[np.cumsum(sizes) - 1] = False
                flat[keep] = ids
                cuts = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), cuts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                begin = (np.cumsum(sizes) - sizes)[row] + start
                crc = np.array([zlib.crc32(flat[a:a + n]) for a, n in zip(begin.tolist(), length.tolist())], dtype="int64")
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
                run_at = np.maximum.accumulate(np.where(first, np.arange(len(ranked)), 0))
                nth = np.empty(len(ranked), dtype="int64")
                nth[order] = np.arange(len(ranked)) - run_at + seen[ranked]
                seen += np.bincount(length, minlength=capacity + 1)
                out = [rows.column(0).take(pa.array(row)).cast(pa.int64()), pa.array(piece.astype("int32")), pa.array(start), pa.array(length),
                       pa.array(crc), pa.array(np.full(len(row), part, dtype="int32")), pa.array(nth)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([begin, [len(flat)]]).astype("int32")), pa.array(flat.view("<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)
        tok.forget()  # the worker goes on to other stages
        give_back()

    return pick(docs, ["doc_id", "text"]).mapInArrow(run, schema)


class OpenBins:
    """Segment tree over remaining capacities; a leaf is non-zero if a bin with that room is open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def set(self, room: int, open_: bool) -> None:
        i = room + self.size
        self.tree[i] = int(open_)
        while i > 1:
            i //= 2
            self.tree[i] = self.tree[2 * i] | self.tree[2 * i + 1]

    def tightest(self, length: int) -> int:
        """The smallest room of at least ``length`` that is open, or -1."""
        i = length + self.size
        if self.tree[i]:
            return length
        while i > 1 and not (i % 2 == 0 and self.tree[i + 1]):
            i //= 2
        if i == 1:
            return -1
        i += 1
        while i < self.size:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.size


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Moves (length, first rank, number, first bin, pieces per bin, offset) of best-fit decreasing.

    ``number`` pieces with ranks from ``first rank`` fill bins one after the other, ``pieces per bin`` in each. Pieces of one
    length come one after the other, so a bin that still fits the same length is the tightest one for the next piece: it is
    filled before another is touched, and a range of equal bins takes one move.
    """
    tree, ranges, moves, bins = OpenBins(capacity), defaultdict(deque), [], 0

    def open_range(room: int, first: int, n: int) -> None:
        if n and room:
            if not ranges[room]:
                tree.set(room, True)
            ranges[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room >= 0:
                first, n = ranges[room].popleft()
                if not ranges[room]:
                    tree.set(room, False)
            else:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            fit = room // length
            full = min(n, left // fit)
            if full:
                moves.append((length, rank, full * fit, first, fit, capacity - room))
                open_range(room - fit * length, first, full)
                left, rank = left - full * fit, rank + full * fit
            if full < n and left:
                moves.append((length, rank, left, first + full, left, capacity - room))
                open_range(room - left * length, first + full, 1)
                full, left = full + 1, 0
            open_range(room, first + full, n - full)
    return moves


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked, ids. Null text: the final id alone.
    Null ids and repeated rows: packed like any row. An empty table gives no rows. Extra columns are ignored.
    """
    found = materialise(pieces(docs, tokenizer_path, capacity, with_ids), "pieces")
    per_part = materialise(found.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    totals = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    moves = np.array(plan_bins(totals, capacity), dtype="int64").reshape(-1, 6)
    # parts of a length, numbered on: chunks of 1,024 parts first, so that no window holds more than one row for each chunk
    chunk = per_part.withColumn("chunk", F.expr("part div 1024"))
    sums = chunk.groupBy("length", "chunk").agg(F.sum("n").alias("m"))
    sums = sums.withColumn("before", F.expr("sum(m) over (partition by length order by chunk) - m")).drop("m")
    starts = (
        chunk.withColumn("within", F.expr("sum(n) over (partition by length, chunk order by part) - n"))
        .join(sums, ["length", "chunk"])
        .select("part", "length", (F.col("within") + F.col("before")).alias("base"))
    )
    ranked = found.join(starts, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.int64(1) << np.int64(48)
        keys = (moves[:, 0]) * wide + moves[:, 1]
        order = np.argsort(keys)
        table, keys = moves[order], keys[order]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            m = table[np.searchsorted(keys, length * wide + rank, side="right") - 1]
            k = rank - m[:, 1]
            columns = [batch.column(i) for i in range(5)] + [pa.array(m[:, 3] + k // m[:, 4]), pa.array(m[:, 5] + (k % m[:, 4]) * length)]
            extra = [batch.column(6)] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns + extra, names=[*names, "sequence_id", "offset", *(["ids"] if with_ids else [])])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint" + (", ids array<int>" if with_ids else "")
    return ranked.select(*names, "rank", *(["ids"] if with_ids else [])).mapInArrow(place, schema)
