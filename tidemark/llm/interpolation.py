"""Scoring with deleted interpolation: bigram, unigram and uniform estimates mixed by the frequency of the context.

Tokens are words (A-Z in lower case) and one end of text, which is also the context of a text's first word. Training documents
form two folds: mixture weights are learned on the counts of the second fold by expectation-maximisation, with estimates from
the first; texts are then scored with estimates from both. Counts are held by ranges of hashes and never in one place
(see ``exchange``); only weights and a table of held-out counts by (bucket, binned estimates) pass through the driver, both
bounded by the numbers of bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exchange as X
from tidemark.llm.common import Words, pair_hash, pick, slices
from tidemark.session import materialise

END = np.uint64(0xE1D0F7E271A9C3B5)
CHUNK_WORDS = 700_000
RANGE_KEYS = 1_500_000
KEY_MASK = ~np.uint64(0xFFFF)  # 48 bits of a bigram's hash: one of n bigrams meets another with a probability of n / 2 ** 48
LEAST_RANGES = 48
BINS = 20  # bins of an estimate for each power of ten
LOWEST = 16 * BINS  # of bins; further down counts as zero
BUCKETS = 48
FIRST, SECOND, HELD = 0, 1, 2

STORE = "chunk bigint, tunes boolean, ids binary, null_ids binary, fold binary, sizes binary, tokens binary, vocab binary, first binary, second binary, n_words bigint"


def fold() -> Column:
    """Held out: crc32 of the id mod 7 is 2; second fold: 3; first: the rest, and null ids."""
    m = F.crc32(F.col("doc_id").cast("string")) % 7
    return F.when(m == 2, HELD).when(m == 3, SECOND).otherwise(FIRST).cast("int")


def chunks(docs: DataFrame) -> DataFrame:
    """Chunks of whole texts as local word numbers, with the sorted hashes of their words and each word's count by fold.

    Texts of the second fold have chunks of their own (``tunes``). Words are numbered by falling count, which compresses well.
    """

    def flush(held: list, number: int) -> pa.RecordBatch:
        ids, nulls, folds, sizes, hashes = (np.concatenate(x) for x in zip(*held))
        vocab, tokens = np.unique(hashes, return_inverse=True)
        by_fold = np.repeat(folds, sizes)
        counts = [np.bincount(tokens[by_fold == f], minlength=len(vocab)).astype("uint32") for f in (FIRST, SECOND)]
        order = _by_count(*counts)
        rank = np.empty(len(vocab), "uint32")
        rank[order] = np.arange(len(vocab), dtype="uint32")
        row = [[(TaskContext.get().partitionId() << 24) + number], [bool(folds[0] == SECOND)], [X.squeeze(ids)], [X.squeeze(nulls)], [X.squeeze(folds)],
               [X.squeeze(sizes.astype("uint32"))], [X.squeeze(rank[tokens])], [X.squeeze_sorted(vocab)], [X.squeeze(counts[0])], [X.squeeze(counts[1])], [len(vocab)]]
        types = [pa.int64(), pa.bool_(), *[pa.binary()] * 8, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names=[c.split()[0] for c in STORE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {False: [], True: []}
        size, number = {False: 0, True: 0}, 0
        for batch in batches:
            for whole in slices(batch, 2):
                tuning = whole.column(1).to_numpy() == SECOND
                for tunes in (False, True):
                    part = whole.filter(pa.array(tuning == tunes))
                    if not part.num_rows:
                        continue
                    w = Words(part.column(2))
                    tokens = np.insert(w.hashes(), w.first[1:], END)
                    ids = part.column(0)
                    held[tunes].append((ids.fill_null(0).to_numpy().astype("int64"), ids.is_null().to_numpy(zero_copy_only=False).astype("uint8"),
                                        part.column(1).to_numpy().astype("uint8"), w.counts + 1, tokens))
                    size[tunes] += len(tokens)
                    if size[tunes] >= CHUNK_WORDS:
                        yield flush(held[tunes], number)
                        held[tunes], size[tunes], number = [], 0, number + 1
        for rest in held.values():
            if rest:
                yield flush(rest, number)
                number += 1

    return pick(docs, ["doc_id", "text"]).select("doc_id", fold().alias("fold"), "text").mapInArrow(run, STORE)


def _by_count(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Places of a chunk's words in the order of their numbers."""
    return np.argsort(-(first.astype("int64") + second), kind="stable")


def _contexts(tokens: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The token before each token; the end of text before the first of a document."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = end
    return before


def _pairs(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, contexts, sizes, sorted distinct bigram hashes, each token's place among them, and the vocabulary."""
    sizes = X.expand(row["sizes"], "uint32").astype("int64")
    tokens = _by_count(X.expand(row["first"], "uint32"), X.expand(row["second"], "uint32"))[X.expand(row["tokens"], "uint32")]
    vocab = X.expand_sorted(row["vocab"])
    before = _contexts(tokens, sizes, int(np.searchsorted(vocab, END)))
    code, at = np.unique(before * len(vocab) + tokens, return_inverse=True)
    key = pair_hash(vocab[code // len(vocab)], vocab[code % len(vocab)]) & KEY_MASK
    order = np.argsort(key)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return tokens, before, sizes, key[order], place[at], vocab


def _word_keys(row: dict):
    return X.expand_sorted(row["vocab"]), X.expand(row["first"], "uint32"), X.expand(row["second"], "uint32")


def _pair_keys(row: dict):
    tokens, _, sizes, key, place, _ = _pairs(row)
    folds = np.repeat(X.expand(row["fold"], "uint8"), sizes)
    return key, *[np.bincount(place[folds == f], minlength=len(key)) for f in (FIRST, SECOND)]


def _bucket(context: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency: 0 for an unseen one, then two for each power of two."""
    return np.minimum(BUCKETS - 1, np.where(context > 0, 1 + np.floor(1.5 * np.log2(np.maximum(context, 1))), 0)).astype("int64")


def _bin(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.minimum(LOWEST - 1, np.round(-np.log10(np.maximum(p, 1e-300)) * BINS)), LOWEST).astype("int64")


class Estimates:
    """Counts of a chunk's tokens and their maximum-likelihood estimates."""

    def __init__(self, row: dict):
        self.tokens, self.before, self.sizes, _, self.place, _ = _pairs(row)
        self.word, self.pair = X.aligned(row["words"]), X.aligned(row["pairs"])

    def of(self, folds: tuple[int, ...], total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket of the context, bigram and unigram estimate of each token."""
        word, pair = (sum(c[f] for f in folds) for c in (self.word, self.pair))
        context = word[self.before]
        return _bucket(context), pair[self.place] / np.maximum(context, 1), word[self.tokens] / max(total, 1)


TEXTS = ["tokens", "sizes", "vocab", "first", "second"]


def learn_weights(counted: DataFrame, first_total: int, vocabulary: int, rounds: int = 60) -> np.ndarray:
    """Weights of bigram, unigram and uniform estimate for each bucket, from the counted chunks of the second fold."""
    wide = LOWEST + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in X.rows_of(batches):
            bucket, p2, p1 = Estimates(row).of((FIRST,), first_total)
            key, n = np.unique((bucket * wide + _bin(p2)) * wide + _bin(p1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    table = counted.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toArrow()
    return expectation_maximisation(table["key"].to_numpy(), table["n"].to_numpy(), vocabulary, rounds)


def expectation_maximisation(key: np.ndarray, n: np.ndarray, vocabulary: int, rounds: int) -> np.ndarray:
    wide = LOWEST + 1
    bucket = key // (wide * wide)
    value = lambda b: np.where(b < LOWEST, 10.0 ** (-b / BINS), 0.0)
    p = np.stack([value(key // wide % wide), value(key % wide), np.full(len(key), 1 / (vocabulary + 1))], axis=1)
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = [0, 0.5, 0.5]  # an unseen context has no bigram estimate
    prior = np.where(weights > 0, 0.5, 0.0)  # keeps each weight above zero
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / share.sum(axis=1))[:, None]
        mass = prior + np.stack([np.bincount(bucket, share[:, k], minlength=BUCKETS) for k in range(3)], axis=1)
        weights = mass / mass.sum(axis=1, keepdims=True)
    return weights


def language_model_scores(docs: DataFrame) -> DataFrame:
    """Score all whole texts; see the module for the model.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. Null or empty text: the end of text alone.
    A null id is never held out. Repeated rows are learned from and scored as often as they occur. Without training tokens all
    words are unknown and the model is uniform. An empty table gives no rows. Extra columns are ignored.
    """
    store = materialise(chunks(docs), "chunks")
    size = store.agg(F.sum("n_words"), F.count(F.lit(1))).first()
    ranges = max(LEAST_RANGES, -(-int(size[0] or 0) * 6 // RANGE_KEYS))  # a chunk has up to about six bigrams for each distinct word
    words = materialise(X.answers(X.requests(store, ["vocab", "first", "second"], _word_keys, ranges)), "words")
    pairs = materialise(X.answers(X.requests(store, [*TEXTS, "fold"], _pair_keys, ranges)), "pairs")
    counts = words.agg(F.sum("distinct"), F.sum("total")).first()
    vocabulary, total = int(counts[0] or 0), int(counts[1] or 0)

    def counted(chosen: DataFrame, columns: list[str]) -> DataFrame:
        """Chunks with the corpus counts of their words and bigrams."""
        ids = chosen.select("chunk")
        own = [X.gathered(t.join(ids, "chunk", "left_semi"), name) for t, name in ((words, "words"), (pairs, "pairs"))]
        return chosen.select("chunk", *columns).join(own[0], "chunk").join(own[1], "chunk").drop("chunk")

    weights = learn_weights(counted(store.filter("tunes"), TEXTS), first_fold_tokens(store), vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in X.rows_of(batches):
            e = Estimates(row)
            bucket, p2, p1 = e.of((FIRST, SECOND), total)
            w = weights[bucket]
            begin = np.cumsum(e.sizes) - e.sizes
            add = lambda x: np.add.reduceat(x, begin)
            count = (e.word[FIRST] + e.word[SECOND])[e.tokens]
            score = add(np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (vocabulary + 1)))
            base = add(np.log10((count + 1) / (total + vocabulary + 1)))
            ids = pa.array(X.expand(row["ids"], "int64"), mask=X.expand(row["null_ids"], "uint8") == 1)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(X.expand(row["fold"], "uint8") == HELD), pa.array(e.sizes), pa.array(add((count > 0).astype("int64"))),
                 pa.array(np.full(len(begin), total)), pa.array(base), pa.array(score)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return counted(store, [*TEXTS, "fold", "ids", "null_ids"]).mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def first_fold_tokens(store: DataFrame) -> int:
    """Tokens of the first fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(X.expand(b, "uint32").sum()) for b in batch.column(0).to_pylist()], pa.int64())], names=["n"])

    return int(store.select("first").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0)
