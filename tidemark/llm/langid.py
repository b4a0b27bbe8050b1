"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

Subwords are byte windows of ``SIZES`` bytes inside a word and its two borders, letters A-Z in lower case, hashed to buckets.
As the average and the output layer are linear, a trained model is one table of class scores for each bucket: scoring a text
is a mean over its windows. Scores are calibrated by a temperature; a text is rejected if its calibrated probability is below
``min_score`` or if it has no letter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import give_back, mix, over_arrow, pick, text_bytes

SIZES = (3, 4)
SLICE = 1 << 20  # bytes of text at a time: each byte has two windows of some dozen bytes of numbers
UNDETERMINED = "und"
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype="uint64")
_LOWER[65:91] += _U(32)
_LOWER[[9, 10, 11, 12, 13]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages, embedding times output layer
    temperature: float


def windows(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every subword window of a batch; a window never leaves its row."""
    low, space = _LOWER[data], _SPACE[data]
    row = np.repeat(np.arange(len(offsets) - 1, dtype="int32"), np.diff(offsets))
    found, rows = [], []
    for n in SIZES:
        m = len(data) - n + 1
        if m <= 0:
            continue
        ok = row[:m] == row[n - 1:]
        for k in range(1, n - 1):
            ok &= ~space[k:m + k]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, dtype="uint64")
        for k in range(n):
            h = h << _U(8) | low[at + k]
        found.append((mix(h) % _U(buckets)).astype("int64"))
        rows.append(row[at])
    if not found:
        return np.zeros(0, "int64"), np.zeros(0, "int32")
    return np.concatenate(found), np.concatenate(rows)


def features(docs: DataFrame, buckets: int) -> DataFrame:
    """Label, buckets and their counts of each text, as little-endian int32 arrays."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(1))
        bucket, row = windows(data, offsets, buckets)
        key, counts = np.unique(row.astype("int64") * buckets + bucket, return_counts=True)
        at = np.searchsorted(key // buckets, np.arange(batch.num_rows + 1))
        idx, cnt = (key % buckets).astype("<i4"), counts.astype("<i4")
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), cut(idx), cut(cnt)], names=["lang", "idx", "cnt"])

    return over_arrow(docs, ["lang", "text"], run, "lang string, idx binary, cnt binary", SLICE)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], buckets: int, dim: int, min_steps: int, rate: float, seed: int) -> Model:
    """SGD over (language, buckets, counts), at least ``min_steps`` of them; every fifth row is kept for the temperature."""
    languages = sorted({r[0] for r in rows})
    code = {v: i for i, v in enumerate(languages)}
    data = [(code[v], i, (c / c.sum()).astype("float32")) for v, i, c in rows if len(i)]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(data))
    tune, train = [data[k] for k in order[::5]], [data[k] for j, k in enumerate(order) if j % 5]
    train = train or tune
    emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype("float32")
    out = np.zeros((dim, len(languages)), "float32")
    seen = np.zeros(buckets, bool)
    epochs = max(3, -(-min_steps // max(1, len(train))))
    steps, total = 0, max(1, epochs * len(train))
    for _ in range(epochs):
        for k in rng.permutation(len(train)):
            y, idx, w = train[k]
            lr = rate * (1 - steps / total)
            x = w @ emb[idx]
            z = x @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            g = out @ p
            out -= lr * np.outer(x, p)
            emb[idx] -= np.outer(lr * len(idx) * w, g)
            seen[idx] = True
            steps += 1
    table = emb @ out
    table[~seen] = 0
    logits = np.array([w @ table[i] for _, i, w in tune]).reshape(-1, len(languages))
    labels = np.array([y for y, _, _ in tune], dtype=int)

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), labels])) if len(z) else 0.0

    return Model(languages, table.astype("float32"), min(np.geomspace(0.05, 20, 60), key=loss))


def train(docs: DataFrame, usable: Column, max_docs: int = 3000, buckets: int = 1 << 16, dim: int = 16, min_steps: int = 12_000, rate: float = 0.5, seed: int = 7) -> Model | None:
    """Fit on at most ``max_docs`` labelled documents for which ``usable`` holds, those with the smallest md5 of doc_id.

    The bound makes the sample fit on the driver: ids first, then the subword counts of their whole texts. None if there are
    no labelled texts.
    """
    key = F.md5(F.col("doc_id").cast("string"))
    labelled = pick(docs, ["doc_id", "text", "lang"]).filter(usable & F.col("lang").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull())
    ids = labelled.select("doc_id", key.alias("k")).distinct().orderBy("k", "doc_id").limit(max_docs).select("doc_id")
    chosen = labelled.join(F.broadcast(ids), "doc_id", "left_semi")  # max_docs rows of 8 bytes
    table = features(chosen, buckets).toArrow()  # the arrays below are views of it
    columns = [table.column(c).to_pylist() if c == "lang" else [np.frombuffer(x.as_buffer(), "<i4") for x in table.column(c)] for c in ("lang", "idx", "cnt")]
    rows = list(zip(*columns))
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))  # whatever order tasks end in
    rows = [r for r in rows if len(r[1])]
    model = fit(rows, buckets, dim, min_steps, rate, seed) if rows else None
    del table, columns, rows
    give_back()  # the driver's Python lives on as well
    return model


def _scores(model: Model | None, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Predicted language and calibrated score of each text."""
    n = len(column)
    data, offsets = text_bytes(column)
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])[offsets]
    known = np.diff(letters) > 0
    for i in np.flatnonzero(~known & (np.diff(offsets) > 0)):
        known[i] = any(ch.isalpha() for ch in data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    score, best = np.zeros(n), np.zeros(n, int)
    if model is not None:
        bucket, row = windows(data, offsets, len(model.table))
        total = np.maximum(np.bincount(row, minlength=n), 1)
        z = np.stack([np.bincount(row, model.table[:, c][bucket], minlength=n) for c in range(len(model.languages))], axis=1) / total[:, None] / model.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best, score = p.argmax(axis=1), p.max(axis=1)
    known &= model is not None
    names = np.array([*(model.languages if model else []), UNDETERMINED], dtype=object)
    return names[np.where(known, best, -1)], np.where(known, score, 0.0)


def predict(docs: DataFrame, model: Model | None, min_score: float = 0.5) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every document.

    ``lang_pred`` is a learned language; ``und`` with score 0 for a text that is null, empty or without a letter, or if there is
    no model. Null ids and repeated rows are scored like any row.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pred, score = _scores(model, batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score), pa.array(score < min_score)],
                                          names=["doc_id", "lang_pred", "score", "rejected"])

    return over_arrow(docs, ["doc_id", "text"], run, "doc_id bigint, lang_pred string, score double, rejected boolean", SLICE)


def accepted(docs: DataFrame, model: Model | None, min_score: float = 0.5) -> DataFrame:
    """The documents that ``predict`` does not reject, unchanged, in the same pass."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, score = _scores(model, batch.column(4))
        kept = batch.filter(pa.array(score >= min_score))
        order = [0, 4, 1, 2, 3]
        return pa.RecordBatch.from_arrays([kept.column(i) for i in order], names=[kept.schema.names[i] for i in order])

    return over_arrow(docs, ["doc_id", "lang", "source", "n_chars", "text"], run, "doc_id bigint, text string, lang string, source string, n_chars bigint", SLICE)


def held_out() -> Column:
    """One document in five, by the crc32 of its id; never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
