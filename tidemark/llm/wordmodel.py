"""Modified Kneser-Ney bigrams of words, each text scored with its own counts left out.

Tokens are words (A-Z in lower case) and one end of text, which is also the context of a text's first word. All bigrams of all
texts are counted, none in one place: texts are cut into chunks, a chunk asks ranges of hashes for the corpus counts of its
distinct bigrams, and then for what the corpus' distinct bigrams say of each of its words (see ``exchange``). Only the numbers of
keys with counts 1 to 4 pass through the driver. Bigrams back off to continuation counts of words, these to a word's spelling.

A text that is scored with its own counts is told as likely whatever it says, since its rarest words are then known. All counts
are therefore those of the other texts: a text's own bigrams, and the distinct bigrams that occur in no other text, are taken off.
Discounts alone come from the whole corpus. A copy in another row is another text.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exchange as X
from tidemark.llm.common import Words, give_back, pair_hash, pick, slices
from tidemark.session import materialise, scratch_path

KEY_MASK = ~np.uint64(0xFFFF)  # 48 bits of a hash: one of n words or bigrams meets another with a probability of n / 2 ** 48
END = np.uint64(0xE1D0F7E271A9C3B5) & KEY_MASK
CHUNK_TOKENS = 2_000_000
BLOCK_TOKENS = 400_000  # of whole texts that are scored at once
RANGE_TOKENS = 2_000_000
LEAST_RANGES = 48
TURNS = 3  # in which bigrams are asked for; each takes its share of the disk

STORE = "chunk bigint, rows binary, sizes binary, tokens binary, vocab binary, counts binary, spelt binary, n_tokens bigint"
REQUEST = "range int, chunk bigint, keys binary, counts array<binary>"
ANSWER = "chunk bigint, range int, counts array<binary>, tally array<bigint>"

Describe = Callable[[pa.RecordBatch], pa.RecordBatch]
Spell = Callable[[np.ndarray, np.ndarray], np.ndarray]


def spelt_words(w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of some words, each between two blanks, and the offsets; the empty word comes first."""
    size = w.ends[at] - w.starts[at]
    offsets = np.concatenate([[0, 2], 2 + np.cumsum(size + 2)])
    data = np.full(offsets[-1], 32, "uint8")
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    data[np.repeat(offsets[1:-1] + 1, size) + place] = w.data[np.repeat(w.starts[at], size) + place]
    return data, offsets


def chunks(docs: DataFrame, describe: Describe, spell: Spell) -> DataFrame:
    """Chunks of whole texts: local word numbers by falling count, sorted hashes of their words with counts and spelling.

    ``describe`` gives the columns of a slice that go with each text, ``spell`` the log10 probabilities of words by their bytes.
    """

    def flush(held: list, number: int) -> pa.RecordBatch:
        rows, sizes, hashes, known, spelt = zip(*held)
        vocab, tokens, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        rank = np.empty(len(vocab), "uint32")
        rank[_by_count(counts)] = np.arange(len(vocab), dtype="uint32")
        first = np.unique(np.concatenate(known), return_index=True)[1]
        cost = np.clip(np.round(-100 * np.concatenate(spelt)[first]), 0, 65535).astype("uint16")
        row = [[(TaskContext.get().partitionId() << 24) + number], [_packed(rows)], [X.squeeze(np.concatenate(sizes).astype("uint32"))], [X.squeeze(rank[tokens])],
               [X.squeeze_sorted(vocab)], [X.squeeze(counts.astype("uint32"))], [X.squeeze(cost)], [len(tokens)]]
        types = [pa.int64(), *[pa.binary()] * 6, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names=[c.split()[0] for c in STORE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        for batch in batches:
            for part in slices(batch, 2):
                w = Words(part.column(2))
                hashes = w.hashes() & KEY_MASK
                known, at = np.unique(hashes, return_index=True)
                held.append((describe(part), w.counts + 1, np.insert(hashes, w.first[1:], END), np.insert(known, 0, END), spell(*spelt_words(w, at)).astype("float32")))
                size += len(held[-1][2])
                if size >= CHUNK_TOKENS:
                    yield flush(held, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield flush(held, number)
        give_back()

    return pick(docs, ["doc_id", "lang", "text"]).mapInArrow(run, STORE)


def stored(chunked: DataFrame, label: str) -> DataFrame:
    """``chunked`` as a table bucketed by chunk, whose joins move nothing of it. A task writes a file for each of its few chunks."""
    spark = chunked.sparkSession
    name, path = f"word_{label}_{uuid.uuid4().hex}", scratch_path(spark, f"word-{label}")
    chunked.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.scratch = path
    return out


def _by_count(counts: np.ndarray) -> np.ndarray:
    return np.argsort(-counts.astype("int64"), kind="stable")


def _packed(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


class Bigrams:
    """A chunk's tokens as places among its distinct bigrams, which are sorted by the hash of the bigram."""

    def __init__(self, row: dict):
        self.counts = X.expand(row["counts"], "uint32").astype("int64")
        self.vocab = X.expand_sorted(row["vocab"])
        self.sizes = X.expand(row["sizes"], "uint32").astype("int64")
        tokens = _by_count(self.counts).astype("int32")[X.expand(row["tokens"], "uint32")]
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = np.searchsorted(self.vocab, END)
        v = len(self.vocab)
        code, at = np.unique(before.astype("int64") * v + tokens, return_inverse=True)
        del tokens, before
        key = pair_hash(self.vocab[code // v], self.vocab[code % v]) & KEY_MASK
        order = np.argsort(key)
        rank = np.empty(len(order), "int32")
        rank[order] = np.arange(len(order), dtype="int32")
        #: sorted hashes of distinct bigrams; first and second word of each; the bigram that ends at each token
        self.key, code, self.place = key[order], code[order], rank[at]
        self.context, self.word = code // v, code % v


Keys = Callable[[dict], tuple[np.ndarray, list[np.ndarray]]]


def requests(chunked: DataFrame, columns: list[str], keys: Keys, ranges: int, turn: int, turns: int) -> DataFrame:
    """Rows of ``REQUEST`` for the ranges of a turn; ``keys`` gives the sorted hashes of a chunk and its counts of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in X.rows_of(batches):
            key, counts = keys(row)
            edge = np.searchsorted(X.range_of(key, ranges), np.arange(ranges + 1))
            rows = [(i, row["chunk"], X.squeeze_sorted(key[edge[i]:edge[i + 1]]), [X.squeeze(c[edge[i]:edge[i + 1]].astype("uint32")) for c in counts])
                    for i in range(turn, ranges, turns) if edge[i + 1] > edge[i]]
            if not rows:
                continue
            types = [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["range", "chunk", "keys", "counts"])
        give_back()

    return chunked.select("chunk", *columns).mapInArrow(run, REQUEST)


def answers(asked: DataFrame, owned: bool) -> DataFrame:
    """Rows of ``ANSWER``: corpus counts in the order of each request.

    ``owned``: twice the count, plus one for the one chunk that is to speak for the key. The first row of a range has the numbers of
    its distinct keys, of those with a first count of 1, 2, 3 and 4, and the sum of first counts.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        keys = [X.expand_sorted(b) for b in pdf["keys"]]
        edge = np.cumsum([len(k) for k in keys])[:-1]
        unique, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        sums = [np.bincount(at, np.concatenate([X.expand(b, "uint32") for b in c]), minlength=len(unique)).astype("uint64") for c in zip(*pdf["counts"])]
        told = [s[at] for s in sums]
        if owned:
            told = [2 * t for t in told]
            for t in told:
                t[first] += np.uint64(1)
        parts = list(zip(*[np.split(t, edge) for t in told]))
        tally = [len(unique), *[int((sums[0] == k).sum()) for k in range(1, 5)], int(sums[0].sum())]
        return pd.DataFrame({"chunk": pdf["chunk"].to_numpy(), "range": pdf["range"].to_numpy(), "counts": [[X.squeeze(p) for p in ps] for ps in parts],
                             "tally": [tally] + [[0] * len(tally)] * (len(pdf) - 1)})

    return asked.groupBy("range").applyInPandas(run, ANSWER)


def gathered(answered: DataFrame, name: str) -> DataFrame:
    """One row for each chunk with all its answers, as many as there are ranges."""
    return answered.groupBy("chunk").agg(F.collect_list(F.struct("range", "counts")).alias(name), F.array(*[F.sum(F.col("tally")[k]) for k in range(6)]).alias("tally"))


def aligned(parts: list[dict]) -> list[np.ndarray]:
    parts = sorted(parts, key=lambda p: p["range"])
    return [np.concatenate([X.expand(b, "uint64") for b in c]).astype("int64") for c in zip(*[p["counts"] for p in parts])]


def tallies(answered: DataFrame) -> np.ndarray:
    found = answered.agg(*[F.sum(F.col("tally")[k]) for k in range(6)]).first()
    return np.array([int(x or 0) for x in found])


def release(spark: SparkSession) -> None:
    """Shuffle files of what has been written are deleted: requests stay on disk beside the next ones else."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()


@dataclass
class Discounts:
    """Of bigrams and of continuation counts, by count 0, 1, 2 and 3 or more; tokens, distinct bigrams and the mass that all words discount."""

    bigram: np.ndarray
    word: np.ndarray
    tokens: int
    bigrams: int
    mass: float

    def of_bigrams(self, n: np.ndarray) -> np.ndarray:
        return self.bigram[np.minimum(n, 3)]

    def of_words(self, n: np.ndarray) -> np.ndarray:
        return self.word[np.minimum(n, 3)]


def _grouped(key: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, the place of each key among them, and sums of weights."""
    unique, at = np.unique(key, return_inverse=True)
    return unique, at, *[np.bincount(at, x, minlength=len(unique)) for x in weights]


def log_probabilities(b: Bigrams, count: np.ndarray, words: list[np.ndarray], spelt: np.ndarray, d: Discounts) -> np.ndarray:
    """log10 probability of each text, given the other texts, and by how much it is raised by what comes before its words.

    The second compares with the words' frequencies in the other texts. No model gains by it, on average, where order means nothing.

    ``count``: of each distinct bigram in the corpus. ``words``, for each word: distinct words before it, its tokens (as often it is
    a context), and distinct words after it that follow it once, twice, and in all.
    """
    before, tokens, once, twice, after = words
    held = d.bigram[1] * once + d.bigram[2] * twice + d.bigram[3] * (after - once - twice)
    ends = np.cumsum(b.sizes)
    out, low = np.zeros((2, len(b.sizes))), 0
    while low < len(b.sizes):
        start = ends[low] - b.sizes[low]
        high = max(low + 1, int(np.searchsorted(ends, start + BLOCK_TOKENS, side="right")))
        text, v = np.repeat(np.arange(high - low), b.sizes[low:high]), len(b.vocab)
        # distinct bigrams of each text: how often here, and in the other texts
        code, own = np.unique(text * len(b.key) + b.place[start:ends[high - 1]], return_counts=True)
        text, pair = code // len(b.key), code % len(b.key)
        all_, context, word = count[pair], b.context[pair], b.word[pair]
        rest = all_ - own
        lost = (rest == 0).astype(float)
        _, at, own_tokens, change = _grouped(text * v + context, own, d.of_bigrams(rest) - d.of_bigrams(all_))
        total = tokens[context] - own_tokens[at]
        kept = np.maximum(held[context] + change[at], 0)
        by_word, to, gone, own_words = _grouped(text * v + word, lost, own)
        n = before[by_word % v] - gone.astype("int64")
        bigrams = d.bigrams - np.bincount(text, lost, minlength=high - low)
        mass = d.mass + np.bincount(by_word // v, d.of_words(n) - d.of_words(before[by_word % v]), minlength=high - low)
        of = by_word // v
        share = np.where(bigrams[of] > 0, (n - d.of_words(n) + np.maximum(mass[of], 0) * 10.0 ** spelt[by_word % v]) / np.maximum(bigrams[of], 1), 10.0 ** spelt[by_word % v])
        p = np.where(total > 0, (rest - d.of_bigrams(rest) + kept * share[to]) / np.maximum(total, 1), share[to])
        alone = (tokens[by_word % v] - own_words) / np.maximum(d.tokens - b.sizes[low + of], 1)
        alone = np.where(alone > 0, alone, share)
        p, alone = (np.log10(np.maximum(x, 1e-300)) for x in (p, alone[to]))
        out[:, low:high] = [np.bincount(text, own * x, minlength=high - low) for x in (p, p - alone)]
        low = high
    return out


def word_scores(docs: DataFrame, describe: Describe, schema: str, spell: Spell, discounts: Callable[[np.ndarray], np.ndarray]) -> tuple[DataFrame, list[DataFrame]]:
    """Rows with the columns of ``describe``, and what may be discarded once they are written.

    Further columns: word_log, the mean log10 probability of a token, and order_log, the part of it that the token before makes.
    ``discounts`` makes discounts from the numbers of keys with counts 1 to 4.
    """
    store = stored(chunks(docs, describe, spell), "chunks")
    size = store.agg(F.sum("n_tokens")).first()[0] or 0
    ranges = max(LEAST_RANGES, -(-int(size) // RANGE_TOKENS))
    texts = ["sizes", "tokens", "vocab", "counts"]

    def of_bigrams(row: dict):
        b = Bigrams(row)
        return b.key, [np.bincount(b.place, minlength=len(b.key))]

    with_pairs, written, told = store, [], [f"told_{turn}" for turn in range(TURNS)]
    for turn, name in enumerate(told):
        asked = requests(store, texts, of_bigrams, ranges, turn, TURNS)
        written.append(stored(gathered(answers(asked, True), name), "bigrams"))
        with_pairs = with_pairs.join(written[-1].select("chunk", name), "chunk", "left")
        del asked
        release(store.sparkSession)

    def of_pairs(row: dict) -> np.ndarray:
        """Twice the count of each bigram in the corpus, plus one where this chunk speaks for it."""
        return aligned([x for name in told for x in row[name] or []])[0]

    def of_words(row: dict):
        b = Bigrams(row)
        count, mine = np.divmod(of_pairs(row), 2)
        mine = mine == 1
        v = len(b.vocab)
        sums = [np.bincount(x[keep], minlength=v) for x, keep in ((b.word, mine), (b.context, mine & (count == 1)), (b.context, mine & (count == 2)), (b.context, mine))]
        return b.vocab, [sums[0], b.counts, *sums[1:]]

    words = materialise(answers(requests(with_pairs, [*texts, *told], of_words, ranges, 0, 1), False), "word-continuations")
    release(store.sparkSession)
    seen, found = sum(tallies(x) for x in written), tallies(words)
    e = discounts(found[1:5])
    d = Discounts(discounts(seen[1:5]), e, int(size), int(found[5]), float(e[1] * found[1] + e[2] * found[2] + e[3] * (found[0] - found[1] - found[2])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in X.rows_of(batches):
            b = Bigrams(row)
            logs = log_probabilities(b, of_pairs(row) // 2, aligned(row["words"]), X.expand(row["spelt"], "uint16") / -100.0, d)
            means = [pa.array(x / b.sizes, mask=b.sizes == 1) for x in logs]
            at = 0
            for batch in pa.ipc.open_stream(row["rows"]):
                yield pa.RecordBatch.from_arrays([*batch.columns, *[m.slice(at, batch.num_rows) for m in means]], names=[*batch.schema.names, "word_log", "order_log"])
                at += batch.num_rows
            del b, logs, means
        give_back()

    out = with_pairs.select("chunk", *texts, "spelt", "rows", *told).join(gathered(words, "words").drop("tally"), "chunk").drop("chunk").mapInArrow(run, f"{schema}, word_log double, order_log double")
    return out, [store, *written, words]
