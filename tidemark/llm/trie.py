"""Prefix trie of conversations, built as burst tries over shards.

A conversation is its *path*: one record of ``RECORD`` bytes for each turn, the md5 of role and text and the number of UTF-8 bytes of
the text. Paths compare byte by byte as sequences of turns. Equal paths are one entry with the number of its conversations.

Entries lie in suffix containers under trie heads; the first head is the root. A container of more than ``CONTAINER`` entries or
``CONTAINER_BYTES`` bytes bursts: each entry moves on to the container of its next turn id. What remains is sorted and swept
into nodes, many containers in one task; then the heads that burst get their totals from the containers below, level by level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick
from tidemark.session import materialise

RECORD = 20
CONTAINER = 2048
CONTAINER_BYTES = 16 << 20
CHUNK = 1 << 16  # member ids are joined into lists by ranges of so many ids
NO_ENDS = hashlib.sha256(b"").hexdigest()


def record(role: Column, text: Column) -> Column:
    """A turn in ``RECORD`` bytes as hex digits. The length of the role comes first, so role and text cannot run into each other."""
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.md5(content), F.lpad(F.lower(F.hex(F.octet_length(text))), 2 * RECORD - 32, "0"))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) of each conversation: its turns by turn number, null first, turns of equal number by their record.

    Null role or text: empty. Null conv_id: no conversation. Repeated rows are turns of their own. Empty table: no rows.
    Extra columns are ignored. A conversation is one row, ``RECORD`` bytes a turn, however long its texts are.
    """
    rows = pick(conversations, ["conv_id", "turn", "role", "text"]).filter("conv_id is not null")
    empty = F.lit("")
    turn = F.struct("turn", record(F.coalesce(F.col("role").cast("string"), empty), F.coalesce(F.col("text").cast("string"), empty)).alias("r"))
    listed = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.unhex(F.array_join("t.r", "")).alias("path"))


def entries(members: DataFrame) -> DataFrame:
    """(path, n, first, ends) of each distinct path: its conversations, the smallest id, and the SHA-256 of their ids in order.

    Ids are listed by ranges of ``CHUNK`` ids, so a path that a third of all conversations share is listed by many tasks; only
    the hash itself, which is sequential by definition, reads the lists of one path in order, one list at a time.
    """
    lists = members.groupBy("path", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"), F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    lists = materialise(lists.withColumn("key", F.unhex(F.md5("path"))), "trie-members")
    one = lists.groupBy("key").agg(F.first("path").alias("path"), F.sum("n").alias("n"), F.min("first").alias("first"),
                                   F.count(F.lit(1)).alias("lists"), F.when(F.count(F.lit(1)) == 1, F.sha2(F.first("ids"), 256)).alias("ends"))
    one = materialise(one, "trie-entries")
    if not one.filter("lists > 1").head(1):
        return one.select("path", "n", "first", "ends")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _rows(out)
        if state is not None:
            yield _rows([(key, state.hexdigest())])

    def _rows(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], names=["key", "hash"])

    many = lists.join(one.filter("lists > 1").select("key"), "key", "left_semi").select("key", "chunk", "ids")
    hashes = many.repartition("key").sortWithinPartitions("key", "chunk").select("key", "ids").mapInArrow(digest, "key binary, hash string")
    return one.join(hashes, "key", "left").select("path", "n", "first", F.coalesce("ends", "hash").alias("ends"))


SWEPT = ("parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string")


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of whole containers, from rows (head, parent, depth, above, last, suffix, n, first, ends) sorted by head and suffix."""
    tail = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if tail is None else [tail, batch]).combine_chunks()
        batch = table.to_batches()[0]
        heads = batch.column(0)
        last, whole = heads[-1], batch.num_rows - 1
        while whole and heads[whole - 1] == last:  # the last container may go on in the next batch; a container is bounded
            whole -= 1
        tail = batch.slice(whole)
        if whole:
            yield _nodes(batch.slice(0, whole))
    if tail is not None:
        yield _nodes(tail)


def _nodes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Nodes in preorder: entry by entry, each with the depths that it does not share with the entry before.

    The subtree of a node is the run of nodes up to the first one of the entry that leaves it, so totals are differences of running sums.
    """
    heads, parents, above, suffixes, ends = (batch.column(k).to_pylist() for k in (0, 1, 3, 5, 8))
    base, last, n, first = (batch.column(k).to_numpy() for k in (2, 4, 6, 7))
    rows = len(heads)
    length = np.array([len(s) // RECORD for s in suffixes])
    shared = np.full(rows + 1, -1)  # turns shared with the entry before; -1: another container
    for i in range(1, rows):
        if heads[i] == heads[i - 1]:
            a, b = (np.frombuffer(s, "uint8", min(length[i], length[i - 1]) * RECORD).reshape(-1, RECORD) for s in (suffixes[i - 1], suffixes[i]))
            differ = np.flatnonzero((a != b).any(axis=1))
            shared[i] = differ[0] if len(differ) else len(a)
    fresh = length - shared[:-1]
    start = np.concatenate([[0], np.cumsum(fresh)])  # the first node of each entry
    row = np.repeat(np.arange(rows), fresh)
    depth = np.arange(start[-1]) - start[row] + shared[row] + 1
    parent, leave = np.arange(start[-1]) - 1, np.zeros(start[-1], "int64")
    open_ = np.zeros(length.max(initial=0) + 2, "int64")  # the node at each depth of the current path
    for i in range(rows + 1):
        if i:
            leave[open_[shared[i] + 1:length[i - 1] + 1]] = i
        if i < rows:
            parent[start[i]] = open_[shared[i]] if shared[i] >= 0 else -1
            open_[shared[i] + 1:length[i] + 1] = np.arange(start[i], start[i + 1])
    run = np.stack([row, leave], axis=1).reshape(-1)
    conv = np.minimum.reduceat(np.append(first, np.iinfo("int64").max), run)[::2]
    convs = np.concatenate([[0], np.cumsum(n)])
    n_convs = convs[leave] - convs[row]
    children = np.bincount(parent[parent >= 0], minlength=len(row))
    texts = np.frombuffer(b"".join(suffixes), "uint8").reshape(-1, RECORD)[:, 16:]
    texts = np.append(np.ascontiguousarray(texts).view(">u4").reshape(-1).astype("int64"), 0)  # bytes of each turn
    top = depth == 0
    size = np.where(top, last[row], texts[(np.cumsum(length) - length)[row] + depth - 1])
    totals = [np.concatenate([[0], np.cumsum(x)]) for x in (children == 0, (n_convs - 1) * size)]
    n_leaves, saved = (t[start[leave]] - t[:-1] for t in totals)
    up = [above[r] if t else int(c) for r, t, c in zip(row, top, conv[np.maximum(parent, 0)])]
    link = [parents[r] if t else None for r, t in zip(row, top)]
    sha = [ends[r] if d == length[r] else NO_ENDS for r, d in zip(row, depth)]
    out = [pa.array(link, pa.binary()), pa.array(conv), pa.array(depth + base[row]), pa.array(up, pa.int64()), pa.array(n_convs),
           pa.array(children.astype("int64")), pa.array(n_leaves.astype("int64")), pa.array(saved), pa.array(sha, pa.string())]
    return pa.RecordBatch.from_arrays(out, names=[f.split()[0] for f in SWEPT.split(", ")])


def prefix_trie(members: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the paths of ``members`` (conv_id, path), the empty one included.

    conv_id, the smallest member; depth; parent_conv_id, null for the root; n_convs; n_children; n_leaves and saved_tokens of the subtree,
    saved_tokens being the bytes of a node's last text for every member but one; ends_sha256 of the ids that end there, in order.
    Empty path: a member of the root alone. Empty table: no rows. Equal paths: one set of nodes. conv_id must be unique and not null.
    """
    none = F.lit(None)
    rows = entries(members).select(none.cast("binary").alias("parent"), F.unhex(F.lit("00")).alias("head"), F.lit(0).cast("long").alias("depth"),
                                   none.cast("long").alias("above"), F.lit(0).cast("long").alias("last"), F.col("path").alias("suffix"), "n", "first", "ends")
    held, burst = None, []
    while True:
        rows = materialise(rows, "trie-containers")
        size = rows.groupBy("head").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.length("suffix")).alias("bytes"), F.min("first").alias("conv_id"))
        fat = size.filter((F.col("entries") > 1) & ((F.col("entries") > CONTAINER) | (F.col("bytes") > CONTAINER_BYTES)))
        fat = materialise(fat.select("head", "conv_id"), "trie-bursting")
        stay = rows.join(fat, "head", "left_anti")
        held = stay if held is None else held.unionByName(stay)
        if not fat.head(1):
            break
        burst.append(rows.join(fat, "head"))
        child = F.unhex(F.md5(F.concat("head", F.substring("suffix", 1, RECORD))))
        rows = burst[-1].filter(F.length("suffix") > 0).select(
            F.col("head").alias("parent"), child.alias("head"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"),
            F.conv(F.hex(F.substring("suffix", 17, RECORD - 16)), 16, 10).cast("long").alias("last"),
            F.expr(f"substring(suffix, {RECORD + 1})").alias("suffix"), "n", "first", "ends")
    ordered = held.select("head", "parent", "depth", "above", "last", "suffix", "n", "first", "ends").repartition("head").sortWithinPartitions("head", "suffix")
    nodes = ordered.mapInArrow(sweep, SWEPT)
    if burst:
        nodes = _with_heads(materialise(nodes, "trie-nodes"), burst)
    return nodes.drop("parent", "head")


def _with_heads(nodes: DataFrame, burst: list[DataFrame]) -> DataFrame:
    """The nodes with those of the heads that burst, from the deepest level up: a head adds up the nodes just below it."""
    below = nodes.filter("parent is not null").select("parent", "n_leaves", "saved_tokens")
    for rows in reversed(burst):
        own = rows.groupBy("head", "parent", "depth", "above", "last", "conv_id").agg(
            F.sum("n").alias("n_convs"), F.max(F.when(F.length("suffix") == 0, F.col("ends"))).alias("ends"))
        totals = below.groupBy(F.col("parent").alias("head")).agg(
            F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        heads = materialise(own.join(totals, "head").select(
            "parent", "conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("last")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")), "trie-heads")
        nodes = nodes.unionByName(heads)
        below = below.unionAll(heads.filter("parent is not null").select("parent", "n_leaves", "saved_tokens"))
    return nodes
