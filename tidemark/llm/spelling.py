"""Spelling variants: exact neighbours of words at one edit by a dictionary of trie-node pairs.

The words are sorted and swept into a trie, whose nodes are numbered, and so are the reversed words. A word cut at a position is a
pair of integers, the node of what stands before and the node of what stands behind. Pairs that skip a character and pairs that
skip none meet where they are equal: two skipped characters in one place are a replacement, a skipped one and none an insertion.
A pair holds one word that skips nothing and, for each letter, one that skips it, so a group is as small as the alphabet.

Trie numbers: a task numbers the new nodes of each word in order. Nodes that the first word of a task shares with the last word of
the task before get that one's numbers; for this each task hands over its first and last word, nothing else. The number of a
word's own node grows with the word, so numbers order words by code points.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import over_arrow, text_bytes
from tidemark.session import materialise

LETTERS = r"[A-Za-zÀ-ÿ]+"
SHORT = 48  # lengths for which the shift of a checksum is tabled
BITS = 40  # of a node number below its task
_U = np.uint32


def _byte_step() -> np.ndarray:
    """The 256 entries of the table of CRC-32, from its polynomial."""
    t = np.arange(256, dtype="uint32")
    for _ in range(8):
        t = np.where(t & _U(1), (t >> _U(1)) ^ _U(0xEDB88320), t >> _U(1))
    return t


_STEP = _byte_step()


def crc_after(head: np.ndarray, length: int) -> np.ndarray:
    """What the CRC-32 ``head`` of some bytes adds to that of the same bytes with ``length`` more; the rest is the CRC-32 of these."""
    for _ in range(length):
        head = _STEP[head & _U(255)] ^ (head >> _U(8))
    return head


def _shift_tables() -> list[np.ndarray]:
    """tables[b]: four tables of 256 that shift a checksum by 2 ** b bytes, each for one byte of it."""
    byte = np.arange(256, dtype="uint32")
    tables = [np.stack([crc_after(byte << _U(8 * k), 1) for k in range(4)])]
    while len(tables) < 40:
        tables.append(_shifted(tables[-1], tables[-1]))
    return tables


def _shifted(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & _U(255)] ^ table[1][x >> _U(8) & _U(255)] ^ table[2][x >> _U(16) & _U(255)] ^ table[3][x >> _U(24)]


_SHIFTS = _shift_tables()


def checksums(ids: list, row: np.ndarray, words: np.ndarray, length: np.ndarray, word: np.ndarray) -> np.ndarray:
    """CRC-32 of ``<id>:<word>`` for each occurrence, from one checksum for each id and one for each distinct word."""
    heads = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], "uint32")
    short = [heads]
    for _ in range(SHORT):
        short.append(crc_after(short[-1], 1))
    short = np.stack(short)
    size = length[word]
    out = short[np.minimum(size, SHORT), row]
    for at in np.flatnonzero(size > SHORT):
        x, n = heads[row[at]], int(size[at])
        for b in range(n.bit_length()):
            if n >> b & 1:
                x = _shifted(_SHIFTS[b], x)
        out[at] = x
    return out ^ words[word]


def runs(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All maximal runs of ``LETTERS`` in the texts, with A-Z lower-cased, and the row of each."""
    data, offsets = text_bytes(column)
    lead = data == 0xC3  # U+00C0 to U+00FF, with whatever byte follows
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | lead
    letter[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = letter.copy()
    start[1:] &= ~letter[:-1] | edge[1:-1]
    kept = data[letter]
    kept = np.where((kept >= 65) & (kept <= 90), kept + 32, kept).astype("uint8")
    first = np.flatnonzero(start)
    ends = np.append(np.flatnonzero(start[letter]), len(kept)).astype("int64")
    words = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
    return words, np.searchsorted(offsets, first, side="right") - 1


def word_counts(docs: DataFrame, spoil: int = 97) -> DataFrame:
    """(word, n): the runs of all texts after the edit of the contract, with their numbers.

    h is the unsigned CRC-32 of ``<doc_id>:<run>``; where ``spoil`` divides it the run loses its code point h % length. What becomes
    empty is no word. Null text: no runs. Null id: taken as the text "null". Repeated rows count each. Extra columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, row = runs(batch.column(1))
        coded = found.dictionary_encode()
        word = coded.indices.to_numpy().astype("int64")
        distinct = coded.dictionary
        texts = distinct.to_pylist()
        sums = np.array([zlib.crc32(t.encode()) for t in texts], "uint32")
        length = pc.binary_length(distinct).to_numpy().astype("int64")
        ids = ["null" if i is None else i for i in batch.column(0).to_pylist()]
        h = checksums(ids, row, sums, length, word)
        hit = h % _U(spoil) == 0
        n = np.bincount(word[~hit], minlength=len(texts))
        changed = []
        for w, x in zip(word[hit].tolist(), h[hit].tolist()):
            t = texts[w]
            changed.append(t[:x % len(t)] + t[x % len(t) + 1:])
        seen = np.flatnonzero(n)
        words = pa.concat_arrays([distinct.take(pa.array(seen)), pa.array(changed, pa.large_string())]).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(np.concatenate([n[seen], np.ones(len(changed), "int64")]))], names=["word", "n"])

    counted = over_arrow(docs, ["doc_id", "text"], run, "word string, n bigint", 16 << 20)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter("word <> ''")


def _code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), "uint32")
    return flat, np.concatenate([[0], np.cumsum(pc.utf8_length(column).to_numpy().astype("int64"))])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node numbers of all prefixes of sorted distinct words, from column 0; other columns pass through."""
    base = TaskContext.get().partitionId() << BITS
    before, above, count = np.zeros(0, "uint32"), np.zeros(0, "int64"), 0  # the last word and its nodes
    for batch in batches:
        if not batch.num_rows:
            continue
        flat, first = _code_points(batch.column(0))
        length = np.diff(first)
        row = np.repeat(np.arange(len(length)), length)
        place = np.arange(len(flat)) - first[row]
        ahead = np.concatenate([[len(before)], length[:-1]])
        all_ = np.concatenate([before, flat])
        begin = np.concatenate([[0], first[:-1] + len(before)])
        known = place < ahead[row]
        same = known & (all_[np.where(known, begin[row] + place, 0)] == flat) if len(flat) else known
        never = np.iinfo("int64").max
        shared = np.minimum(np.minimum.reduceat(np.append(np.where(same, never, place), never), first[:-1]), length)
        shared[length == 0] = 0
        fresh = length - shared
        if not len(above):  # the root is the first node of a task
            above, count = np.array([base]), 1
        numbers = np.zeros(len(flat), "int64")
        new = place >= shared[row]
        numbers[new] = base + count + np.arange(fresh.sum())
        count += int(fresh.sum())
        active = np.flatnonzero(length > 0)
        for d in range(int(length.max(initial=0))):
            active = active[length[active] > d]
            at = first[active] + d
            values = numbers[at]
            if len(active) and active[0] == 0 and not new[at[0]]:
                values[0] = above[d + 1]
            numbers[at] = np.maximum.accumulate(values)
        nodes = np.insert(numbers, first[:-1], above[0])
        last = slice(first[-2], first[-1])
        before, above = flat[last], np.concatenate([above[:1], numbers[last]])
        lists = pa.ListArray.from_arrays(pa.array((first + np.arange(len(first))).astype("int32")), pa.array(nodes))
        task = pa.array(np.full(len(length), base >> BITS))
        yield pa.RecordBatch.from_arrays([*batch.columns, task, lists], names=[*batch.schema.names, "task", "nodes"])


def trie_nodes(words: DataFrame, label: str) -> DataFrame:
    """The words, distinct in their first column, with ``nodes``: the numbers of the trie nodes of their prefixes, the empty one first."""
    key = words.columns[0]
    schema = ", ".join(f"{n} {t}" for n, t in words.dtypes) + ", task long, nodes array<long>"
    swept = materialise(words.repartitionByRange(key).sortWithinPartitions(key).mapInArrow(_numbered, schema), label)
    ends = swept.groupBy("task").agg(F.min(key).alias("low"), F.max_by("nodes", key).alias("nodes"), F.max(key).alias("high")).orderBy("task").collect()
    moved, above = [], None  # one row for each node that tasks share; the driver holds two words of each task
    for r in ends:
        own = list(r["nodes"])
        if above is not None:
            high, nodes = above
            n = 0
            while n < min(len(high), len(r["low"])) and high[n] == r["low"][n]:
                n += 1
            taken = {(r["task"] << BITS) + d: nodes[d] for d in range(n + 1)}
            moved += taken.items()
            own = [taken.get(x, x) for x in own]
        above = r["high"], own
    if not moved:
        return swept.drop("task")
    spark = words.sparkSession
    given = spark.createDataFrame(moved, "node long, number long").groupBy(F.shiftright("node", BITS).alias("task")).agg(
        F.map_from_entries(F.collect_list(F.struct("node", "number"))).alias("given"))
    renamed = F.transform("nodes", lambda x: F.coalesce(F.element_at("given", x), x))
    return swept.join(given, "task", "left").withColumn("nodes", F.when(F.col("given").isNotNull(), renamed).otherwise(F.col("nodes"))).drop("task", "given")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, number, n_near, best) for each word of (word, n): neighbours at one edit, and the best of them.

    ``best`` is (-n, number) of the neighbour of largest n, ties to the smallest in code-point order; null without neighbours.
    """
    forward = trie_nodes(words.select("word", "n"), "word-trie").withColumn("number", F.element_at("nodes", -1))
    forward = materialise(forward, "words")
    back = trie_nodes(forward.select(F.reverse("word").alias("word"), "number"), "reversed-trie").select("number", F.col("nodes").alias("behind"))
    both = forward.withColumnRenamed("nodes", "ahead").join(back, "number")
    letter = lambda i: F.substring(F.col("word"), i, F.lit(1))
    # position i from 0: ahead[i + 1] is the node before it, behind[size - i - ...] the one after it
    skipped = F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda i: F.struct(
        F.element_at("ahead", i + 1).alias("p"), F.element_at("behind", F.length("word") - i).alias("s"), F.lit(True).alias("skips"),
        ((i == 0) | (letter(i) != letter(i + 1))).alias("first")))
    kept = F.transform(F.sequence(F.lit(0), F.length("word")), lambda i: F.struct(
        F.element_at("ahead", i + 1).alias("p"), F.element_at("behind", F.length("word") - i + 1).alias("s"), F.lit(False).alias("skips"), F.lit(True).alias("first")))
    cuts = both.select("number", "n", F.explode(F.concat(skipped, kept)).alias("c")).select("c.*", "number", (-F.col("n")).alias("less"))
    # of a run of equal letters only the first one counts as skipped against a word that skips none
    groups = cuts.groupBy("p", "s").agg(F.collect_list(F.struct("less", "number", "skips", "first")).alias("m")).filter("size(m) > 1")
    one = groups.select(F.explode("m").alias("x"), "m").select("x", F.filter("m", lambda y: (y["number"] != F.col("x.number")) & (
        (F.col("x.skips") & y["skips"]) | (F.col("x.skips") != y["skips"]) & F.col("x.first") & y["first"])).alias("near")).filter("size(near) > 0")
    best = F.array_min(F.transform("near", lambda y: F.struct(y["less"].alias("less"), y["number"].alias("number"))))
    found = one.select(F.col("x.number").alias("number"), F.size("near").alias("k"), best.alias("best"))
    found = found.groupBy("number").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))
    return forward.drop("nodes").join(found, "number", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))


def variant_groups(counts: DataFrame, least_length: int = 5, least_n: int = 3, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of (word, n) with ``least_length`` code points and ``least_n`` occurrences.

    Two words are near if one inserted, deleted or replaced code point turns one into the other. The form of a word is its near word
    of largest n, ties to the smallest in code-point order, if that n is ``ratio`` times its own or more; root follows forms to the
    last. ``ratio`` must be 2 or more, so that forms cannot go round. (word, n): each word once. Empty table: no rows.
    """
    words = near_words(counts.filter((F.length("word") >= least_length) & (F.col("n") >= least_n)))
    form = F.when(-F.col("best.less") >= F.col("n") * ratio, F.col("best"))
    words = materialise(words.select("number", "word", "n", "n_near", form["number"].alias("form"), (-form["less"]).alias("form_n")), "word-forms")
    ends = words.filter("form is not null").select("number", F.col("form").alias("root"))
    while True:  # each round doubles the number of forms that are followed
        ends = materialise(ends, "word-roots")
        on = ends.select(F.col("number").alias("root"), F.col("root").alias("on"))
        moved = ends.join(on, "root")
        if not moved.head(1):
            break
        ends = ends.join(on, "root", "left").select("number", F.coalesce("on", "root").alias("root"))
    names = words.select(F.col("number").alias("k"), F.col("word").alias("name"))
    out = words.join(ends, "number", "left")
    out = out.join(names.toDF("form", "form_word"), "form", "left").join(names.toDF("root", "root_word"), "root", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
