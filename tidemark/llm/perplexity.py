"""Quality rules: document statistics and bands of n-gram perplexity.

Two interpolated modified Kneser-Ney models are learned from all texts. One has bigrams of words, whatever their number (see
``wordmodel``); each text is scored by the others. Its words fall back on the second, of order 4 over classes of UTF-8 bytes, which
tells how words are spelt. Its alphabet has ``CLASSES`` members, so it has at most ``CLASSES ** 4`` (5.3 million) n-grams: Spark
counts all of them over all texts, and the sorted arrays of n-gram keys and log probabilities are small enough to send to every task.

Bands of the log perplexity of bytes are Tukey fences, a pair for each language, from documents labelled as good or, where these
are few, from the main mode of all documents that pass the base rules; junk short of a majority does not move either. Words have an
upper fence only: what other texts make too likely is a copy, and these are left to operators that tell which one to keep. Texts
that gain less by the order of their words than one in 200 of the good ones are out too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import _BREAK, _PLAIN, Words, _powers, mix, pick, slices, text_bytes
from tidemark.llm.wordmodel import word_scores
from tidemark.session import discard, materialise

ORDER = 4
CLASSES = 48
_U = np.uint64
WINDOW = 8
BIN = 0.002
LEAST = 20  # documents of a reference

_CLASS = np.zeros(256, dtype="int32")
_CLASS[:] = 30
_CLASS[65:91] = _CLASS[97:123] = np.arange(26)
_CLASS[48:58] = 26
_CLASS[[9, 11, 12, 13, 32]] = 27
_CLASS[10] = 28
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 29
_CLASS[128:] = 31 + np.arange(128) % 17
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MEMBERS = np.log10(np.bincount(_CLASS, minlength=CLASSES))  # of a class of bytes; words have lower case only and no breaks
_MEMBERS[[*range(26), 27, 28]] = 0


def codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Base-48 code of the class n-gram that ends at each byte; before a text stand newlines."""
    cls = _CLASS[data]
    code, begins = cls.copy(), offsets[:-1]
    sizes = np.diff(offsets)
    for k in range(1, ORDER):
        prev = np.empty_like(cls)
        prev[k:] = cls[:-k] if k < len(cls) else 0
        prev[:k] = _CLASS[10]
        for j in range(k):
            prev[begins[sizes > j] + j] = _CLASS[10]
        code += prev * CLASSES ** k
    return code


def count_ngrams(docs: DataFrame) -> DataFrame:
    """Counts of n-gram codes over all texts: one dense array for each task, then a sum by code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES ** ORDER, dtype="int64")
        for batch in batches:
            for part in slices(batch, 0):
                total += np.bincount(codes(*text_bytes(part.column(0))), minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype("int32")), pa.array(total[found])], names=["code", "n"])

    return pick(docs, ["text"]).mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


@dataclass
class KneserNey:
    """Sorted n-gram keys and log10 probabilities of the highest order, and what unseen n-grams back off to."""

    keys: list[np.ndarray]  # for each order from 1
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    gammas: list[np.ndarray]

    def dense(self) -> np.ndarray:
        """log10 probability of every n-gram, seen or not."""
        below = np.full(1, 1.0 / CLASSES)
        for n in range(1, ORDER + 1):
            gamma = np.ones(CLASSES ** (n - 1))
            gamma[self.contexts[n - 1]] = self.gammas[n - 1]
            full = gamma[:, None] * (below.reshape(-1, CLASSES)[np.arange(CLASSES ** (n - 1)) % CLASSES ** max(0, n - 2)] if n > 1 else below)
            full = np.broadcast_to(full, (CLASSES ** (n - 1), CLASSES)).reshape(-1).copy()
            full[self.keys[n - 1]] = 10.0 ** self.logs[n - 1]
            below = full
        return np.log10(below).astype("float32")


def discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more."""
    return discounts_of(np.array([np.count_nonzero(counts == k) for k in range(1, 5)]))


def discounts_of(n: np.ndarray) -> np.ndarray:
    """The same from how many n-grams have counts 1 to 4."""
    n = n.astype(float)
    if (n == 0).any():
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return np.array([0.0, *[min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d)]])


def kneser_ney(code: np.ndarray, n: np.ndarray) -> KneserNey:
    order = np.argsort(code)
    keys, counts = [code[order].astype("int64")], [n[order].astype("int64")]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols to the left
        key, c = np.unique(keys[0] % CLASSES ** k, return_counts=True)
        keys.insert(0, key)
        counts.insert(0, c)
    out, below = KneserNey(keys, [], [], []), None
    for k in range(ORDER):
        c, d = counts[k], discounts(counts[k])
        cut = d[np.minimum(c, 3)]
        context, at = np.unique(keys[k] // CLASSES, return_inverse=True)
        total = np.bincount(at, c, minlength=len(context))
        gamma = np.bincount(at, cut, minlength=len(context)) / np.maximum(total, 1)
        if k == 0:
            lower = np.full(len(c), 1.0 / CLASSES)
        else:
            lower = below[np.searchsorted(keys[k - 1], keys[k] % CLASSES ** k)]
        below = (c - cut) / total[at] + gamma[at] * lower
        out.logs.append(np.log10(below))
        out.contexts.append(context)
        out.gammas.append(gamma)
    return out


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """Word and line statistics of whole texts."""
    w = Words(column)
    n, sizes = len(w.counts), np.diff(w.offsets)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.offsets])
    first_byte = (w.data & 0xC0) != 0x80
    word_chars, symbols = total(first_byte & ~_BREAK[w.data]), total(_SYMBOL[w.data])

    # lines: byte ranges between newlines and text borders; those with a word are compared by row, length and hash
    dup_lines = np.zeros(n, "int64")
    if len(w.starts):
        edge = np.zeros(len(w.data) + 1, bool)
        edge[w.offsets] = True
        edge[np.flatnonzero(w.data == 10)] = True
        edge[np.flatnonzero(w.data == 10) + 1] = True
        cuts = np.flatnonzero(edge)
        begin, end = cuts[:-1], cuts[1:]
        with_word = np.searchsorted(w.starts, end) > np.searchsorted(w.starts, begin)
        up, down = _powers(len(w.data))
        table = _PLAIN.copy()
        table[_BREAK] = mix(np.arange(1000, 1006, dtype="uint64"))
        h = mix(np.add.reduceat(table[w.data] * up[:len(w.data)], begin) * down[begin])
        row = np.searchsorted(w.offsets, begin, side="right") - 1
        row, h = row[with_word], h[with_word] ^ (end - begin)[with_word].astype("uint64") * _U(0x9E3779B97F4A7C15)
        order = np.lexsort((h, row))
        same = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1])
        dup_lines = np.bincount(row[order][1:][same], minlength=n)

    # words in windows that are found again in the same text
    repeat = np.zeros(n, "int64")
    m = len(w.starts) - WINDOW + 1
    if m > 0:
        h, row = w.hashes(fold_case=False), w.rows()
        win = np.zeros(m, "uint64")
        for k in range(WINDOW):
            win = win * _U(0x9E3779B97F4A7C15) + h[k:m + k]
        at = np.flatnonzero(row[:m] == row[WINDOW - 1:])
        win = mix(win[at])
        order = np.lexsort((win, row[at]))
        same = (win[order][1:] == win[order][:-1]) & (row[at][order][1:] == row[at][order][:-1])
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        change = np.zeros(len(h) + 1, "int64")
        np.add.at(change, at[again], 1)
        np.add.at(change, at[again] + WINDOW, -1)
        repeat = np.bincount(row[np.cumsum(change)[:-1] > 0], minlength=n)
    return {"n_words": w.counts, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat, "n_bytes": sizes}


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes"]


SCHEMA = "doc_id bigint, lang string, " + "".join(f"{c} bigint, " for c in STATS) + "mean_log double"


def judges(model: KneserNey | None) -> tuple[Callable[[pa.RecordBatch], pa.RecordBatch], Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """What a task asks of the byte classes.

    Statistics of each document with its mean log10 probability of a byte class (null for an empty text); log10 probabilities of
    words, given as bytes between two blanks.
    """
    loaded: list[np.ndarray] = []

    def logs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if model is not None and not loaded:
            loaded.append(model.dense())
        return loaded[0][codes(data, offsets)] if loaded else np.zeros(len(data), "float32")

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = statistics(batch.column(2))
        data, offsets = text_bytes(batch.column(2))
        logp = np.zeros(len(data) + 1)
        logp[1:] = np.cumsum(logs(data, offsets), dtype="float64")
        mean = np.diff(logp[offsets]) / np.maximum(stats["n_bytes"], 1)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), *[pa.array(stats[c].astype("int64")) for c in STATS], pa.array(mean, mask=stats["n_bytes"] == 0)],
            names=["doc_id", "lang", *STATS, "mean_log"])

    def spell(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        logp = logs(data, offsets) - _MEMBERS[_CLASS[data]]
        logp[offsets[:-1]] = 0
        return np.add.reduceat(logp, offsets[:-1])

    return describe, spell


def fences(bins: np.ndarray, n: np.ndarray, reference: np.ndarray, fence: float) -> tuple[float, float]:
    """Lowest and highest accepted bin of a histogram (ascending bins, documents ``n``, of which ``reference`` are known to be good).

    Quartiles and ``fence`` quartile ranges beyond: of the reference if it has ``LEAST`` documents, else of the main mode. That is
    what lies within the fence of the shortest interval with half of the documents, which others than a majority cannot move;
    then again within the fence of its quartiles until nothing changes.
    """

    def beyond(first: float, last: float) -> tuple[float, float]:
        reach = fence * max(last - first, 5)
        return first - reach, last + reach

    def tukey(x: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
        upto = np.cumsum(counts)
        return beyond(*(x[np.searchsorted(4 * upto, k * upto[-1])] for k in (1, 3)))

    if reference.sum() >= LEAST:
        return tukey(bins, reference)
    upto = np.cumsum(n)
    end = np.searchsorted(2 * upto, 2 * (upto - n) + upto[-1])  # of the shortest interval from each bin that has half of all
    begin = np.flatnonzero(end < len(bins))
    at = begin[np.argmin(bins[end[begin]] - bins[begin])]
    found = beyond(bins[at], bins[end[at]])
    for _ in range(50):
        inside = (bins >= found[0]) & (bins <= found[1])
        last, found = found, tukey(bins[inside], n[inside])
        if found == last:
            break
    return found


def upper_fence(bins: np.ndarray, n: np.ndarray, reference: np.ndarray, fence: float) -> float:
    """Highest accepted bin of words: ``fence`` times the distance of the 17th to the 19th twentieth beyond the latter.

    Of the reference if it has ``LEAST`` documents, else of all. Copies of other texts are a mode of their own, far below; these
    twentieths lie above it while copies are fewer than four in five.
    """
    first, last = _quantiles(bins, n, reference, 17 / 20, 19 / 20)
    return last + fence * max(last - first, 5)


def _quantiles(bins: np.ndarray, n: np.ndarray, reference: np.ndarray, *shares: float) -> list[float]:
    upto = np.cumsum(reference if reference.sum() >= LEAST else n)
    return [bins[np.searchsorted(upto, share * upto[-1])] for share in shares]


def fenced(judged: DataFrame, column: str, names: list[str], run: Callable[..., Iterable[float]]) -> DataFrame:
    """``run`` over the histogram of a column for each language (some thousand bins at most)."""
    hist = judged.filter(F.col(column).isNotNull()).groupBy("band", F.col(column).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count("good").alias("reference"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        found = run(*(rows[c].to_numpy() for c in ("bin", "n", "reference")))
        return pd.DataFrame({"band": rows["band"].iloc[:1], **{name: float(x) for name, x in zip(names, found)}})

    return hist.groupBy("band").applyInPandas(one, "band string, " + ", ".join(f"{name} double" for name in names))


def quality(docs: DataFrame, fence: float = 3.0, min_words: int = 20, max_repeat_pct: int = 30, labels: DataFrame | None = None) -> DataFrame:
    """Statistics, base verdict, log perplexities (of a byte class, of a word), gain by word order and final verdict of every document.

    ``labels`` (doc_id, quality) tells documents that are known to be good, quality 1; without it bands come from main modes, and
    the fences of words and their order from all documents within them.
    Null or empty text: no words, so it fails the base rules and has no perplexity. A null language has bands of its own, and a
    language without any document that passes the base rules has none. Null ids and repeated rows count like any row.
    """
    found = count_ngrams(docs).toArrow()  # at most CLASSES ** ORDER rows
    model = kneser_ney(found["code"].to_numpy(), found["n"].to_numpy()) if found.num_rows else None
    describe, spell = judges(model)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    scored, used = word_scores(docs, describe, SCHEMA, spell, discounts_of)
    scored = (
        scored.withColumn("base_failed", failed).withColumn("log_perplexity", -F.col("mean_log")).withColumn("word_log_perplexity", -F.col("word_log"))
        .withColumn("bin", F.floor(F.col("log_perplexity") / BIN)).withColumn("word_bin", F.floor(F.col("word_log_perplexity") / BIN))
        .withColumn("order_bin", F.floor(F.col("order_log") / BIN))
        .withColumn("band", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")))
    )
    scored = materialise(scored, "perplexity")
    discard(*used)
    good = docs.sparkSession.range(0).withColumnRenamed("id", "doc_id") if labels is None else pick(labels, ["doc_id", "quality"]).filter("quality = 1")
    judged = scored.filter(~F.col("base_failed")).select("doc_id", "band", "bin", "word_bin", "order_bin")
    judged = judged.join(good.select("doc_id", F.lit(1).alias("good")).distinct(), "doc_id", "left")
    # written, since by its size in files a table of few languages is broadcast: no language goes to one task
    bands = materialise(fenced(judged, "bin", ["low", "high"], lambda bins, n, reference: fences(bins, n, reference, fence)), "bands")
    inside = F.coalesce(F.col("bin").between(F.col("low"), F.col("high")), F.lit(False))
    within = judged.join(bands, "band").filter(inside)
    words = materialise(fenced(within, "word_bin", ["word_high"], lambda bins, n, reference: (upper_fence(bins, n, reference, fence),)), "word-bands")
    order = materialise(fenced(within, "order_bin", ["order_low"], lambda bins, n, reference: _quantiles(bins, n, reference, 1 / 200)), "order-bands")
    likely = F.coalesce((F.col("word_bin") <= F.col("word_high")) & (F.col("order_bin") >= F.col("order_low")), F.lit(False))
    return scored.join(bands, "band", "left").join(words, "band", "left").join(order, "band", "left").withColumn("kept", ~F.col("base_failed") & inside & likely)
