"""Near-duplicate detection: a chosen-path set similarity join over word shingles.

A document is its set of shingles. Documents with equal sets form a class, which has a number of its own and goes on as one; below,
documents are classes. Each tree branches the documents by minwise tokens: a node is the documents that share the tokens chosen
along its path. Nodes of at most ``NODE_LIMIT`` documents are compared exhaustively by sketches, nodes of the same documents once;
larger ones are branched again, unless most of their documents are close to a few of their own members: those are compared with
these pivots instead. Independent trees are repeated to the target recall.

Links are wanted for components, so the pairs that the sketches let through are confirmed in two steps: first one partner for
each document, then, with the components found, every remaining pair whose documents are still in different components; no text
moves for the others. All confirmations are exact, on full sets made from the texts.

Recall: a pair of similarity s meets in a tree with probability at least 1 - (1 - s * (1 - (1 - s * f) ** 2)) ** 4, where f is
0.99 or more for nodes that are branched on (three children for each level). At s = 0.8 a tree misses 0.3 % of such pairs, and
three trees miss about 3e-8. The sketch of 63 tokens of 7 bits lets a pair through from 34 equal tokens on, which it misses
with a probability of about 1e-7 at s = 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Words, co_located, mix, over_arrow, pick, slices
from tidemark.llm.components import components
from tidemark.session import discard, materialise

TOKENS = 63
LANES = 7  # tokens in a long of the sketch, 8 bits apart, the top byte free
TREES = 3
NODE_LIMIT = 48
LEVELS = 2  # below the first two
PIVOTS = 1
_U = np.uint64
_ODD = mix(np.arange(11, 11 + TOKENS, dtype="uint64")) | _U(1)
SKETCH = [f"s{i}" for i in range(TOKENS // LANES)]
FULL, HIGH = 0x007F7F7F7F7F7F7F, 0x0080808080808080


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within the text, and the n + 1 offsets of the texts.

    A text with fewer words than ``width`` has its whole sequence as one shingle; without words it has none.
    """
    w = Words(column)
    h, counts = w.hashes(), w.counts
    if not len(h):
        return np.zeros(0, "uint64"), np.zeros(len(counts) + 1, "int64")
    size = np.maximum(counts - width + 1, np.minimum(counts, 1))
    at = np.repeat(w.first[:-1] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    row = np.repeat(np.arange(len(counts)), size)
    left = np.repeat(np.minimum(counts, width), size)  # words in the shingle
    key = np.zeros(len(at), "uint64")
    last = len(h) - 1
    for k in range(width):
        key = np.where(k < left, key * _U(0x9E3779B97F4A7C15) + h[np.minimum(at + k, last)], key)
    key = mix(key ^ (left.astype("uint64") << _U(56)))
    order = np.argsort(key)
    order = order[np.argsort(row[order].astype("uint16") if len(counts) < 65536 else row[order], kind="stable")]
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, row = key[new], row[new]
    return key, np.searchsorted(row, np.arange(len(counts) + 1))


def _digests(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit sums that identify each set; zero for an empty one."""
    full = np.diff(first) > 0
    out = np.zeros((2, len(full)), "int64")
    if full.any():
        for k in range(2):
            out[k, full] = np.add.reduceat(mix(key ^ _U(0xA5A5 + k)), first[:-1][full]).view("int64")
    return out


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """Size, digest and minwise tokens of each document's set; no tokens for an empty set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, first = shingles(batch.column(1), width)
        n = np.diff(first)
        full = n > 0
        begin = first[:-1][full]
        tokens = np.zeros((batch.num_rows, TOKENS), "int32")
        digest = _digests(key, first)
        if len(begin):
            for k in range(TOKENS):
                tokens[full, k] = (np.minimum.reduceat(key * _ODD[k], begin) >> _U(32)).astype("uint32").view("int32")
        flat = pa.FixedSizeListArray.from_arrays(pa.array(tokens.reshape(-1)), TOKENS).cast(pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n), pa.array(digest[0]), pa.array(digest[1]), flat],
                                          names=["doc_id", "n_shingles", "set_a", "set_b", "tokens"])

    return over_arrow(docs, ["doc_id", "text"], run, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, tokens array<int>")


def sketch() -> list[Column]:
    """The lowest 7 bits of each token, in nine longs."""
    out = []
    for i, name in enumerate(SKETCH):
        lanes = [F.shiftleft((F.element_at("tokens", i * LANES + k + 1).bitwiseAND(0x7F)).cast("long"), 8 * k) for k in range(LANES)]
        total = lanes[0]
        for lane in lanes[1:]:
            total = total.bitwiseOR(lane)
        out.append(total.alias(name))
    return out


def equal_tokens(left: str, right: str) -> Column:
    """How many lanes of two sketches agree: a lane of the exclusive or is zero, so adding 127 leaves its high bit unset."""
    different = None
    for s in SKETCH:
        x = F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))
        n = F.bit_count((x + F.lit(FULL)).bitwiseAND(F.lit(HIGH)))
        different = n if different is None else different + n
    return F.lit(TOKENS) - different


def least_equal(similarity: float) -> int:
    """Equal tokens from which a pair is looked at: five standard deviations below what ``similarity`` gives."""
    p = similarity + (1 - similarity) / 128
    return max(1, int(TOKENS * p - 5.2 * (TOKENS * p * (1 - p)) ** 0.5))


def _first_nodes(reps: DataFrame) -> DataFrame:
    """Nodes of the first two levels: four children for each root, two for each of these."""
    paths = []
    for t in range(TREES):
        for i in range(4):
            at = 12 * t + 3 * i
            for j in (1, 2):
                paths.append(F.xxhash64(F.lit(t), F.lit(at), F.element_at("tokens", at + 1), F.lit(j), F.element_at("tokens", at + j + 1)))
    return reps.select(F.explode(F.array(*paths)).alias("node"), "doc")


def _next_nodes(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Three children for each node, by tokens that the node's key chooses among those the first levels do not use."""
    free = 12 * TREES
    chosen = [F.pmod(F.xxhash64("node", F.lit(j)), F.lit(TOKENS - free)).cast("int") + free + 1 for j in range(3)]
    keys = F.array(*[F.xxhash64("node", F.lit(j), F.element_at("tokens", c)) for j, c in enumerate(chosen)])
    return rows.join(reps.select("doc", "tokens"), "doc").select(F.explode(keys).alias("node"), "doc")


def _nodes(reps: DataFrame, sketched: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, doc) of nodes to compare exhaustively, (node, doc) of dense nodes, and (a, b) of documents near to their pivots.

    Nodes of the same documents have one leader, the smallest; it alone is compared, but all of them are branched on.
    Pivots of a node are the documents with the smallest hashes, so nodes that share documents tend to share pivots.
    """
    rows, small, dense, pivots = _first_nodes(reps), [], [], []
    for level in range(LEVELS + 1):
        rows = materialise(rows, "nodes")
        several = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = materialise(rows.join(several, "node"), "shared-nodes")
        picked = [F.min_by("doc", F.xxhash64("doc", F.lit(j))).alias(f"p{j}") for j in range(PIVOTS)]
        members = [F.bit_xor(F.xxhash64("doc", F.lit(100 + j))).alias(f"m{j}") for j in range(2)]
        shapes = shared.groupBy("node", "n").agg(*picked, *members)
        shapes = shapes.withColumn("lead", F.min("node").over(Window.partitionBy("n", "m0", "m1"))).drop("n", "m0", "m1")
        sized = materialise(shared.join(shapes, "node"), "sized-nodes")
        discard(rows, shared)
        leaders = sized.filter("node = lead")
        small.append(leaders.filter(f"n <= {NODE_LIMIT}").select("node", "doc"))
        large = sized.filter(f"n > {NODE_LIMIT}")
        if not large.head(1):
            break
        near = materialise(_near_pivots(large.filter("node = lead"), sketched, least), "near-pivots")
        counts = [F.count_if(F.col("j") == j) for j in range(PIVOTS)]
        packed = near.groupBy("node", "n").agg(F.greatest(F.lit(0), *counts).alias("near"))
        packed = packed.select("node") if level == LEVELS else packed.filter("near * 2 >= n").select("node")
        packed = materialise(packed, "dense-nodes").select(F.col("node").alias("lead"))
        pivots.append(near.select("a", "b"))
        if level == LEVELS:
            dense.append(large.filter("node = lead").select("node", "doc"))
            break
        dense.append(large.filter("node = lead").join(packed, "lead", "left_semi").select("node", "doc"))
        rows = _next_nodes(large.join(packed, "lead", "left_anti").select("node", "doc"), reps)
    empty = reps.select(F.col("doc").alias("node"), "doc").limit(0)
    return _union(small or [empty]), _union(dense or [empty]), _union(pivots or [empty.select(F.col("node").alias("a"), F.col("doc").alias("b"))])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _near_pivots(rows: DataFrame, sketched: DataFrame, least: int) -> DataFrame:
    """(node, n, j, a, b): documents b whose sketch is near that of pivot number j, a, of their node."""
    pivot = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"p{j}").alias("a")) for j in range(PIVOTS)])).alias("p")
    pairs = rows.select("node", "n", F.col("doc").alias("b"), pivot).select("node", "n", "b", "p.*").filter("a <> b")
    own = F.struct(*SKETCH)
    left, right = (sketched.select(F.col("doc").alias(c), own.alias(c * 2)) for c in "ab")
    return pairs.join(left, "a").join(right, "b").filter(equal_tokens("aa", "bb") >= least).select("node", "n", "j", "a", "b")


def compare_nodes(rows: DataFrame, least: int, every: bool) -> DataFrame:
    """Sketches of small nodes against each other.

    ``every`` false: (node, doc, partner, sketch) of each document with a near one in its node; partner is the first of them.
    ``every`` true: (a, b) of all near pairs with different ``label``.
    """
    names = ["node", "doc", "label", *SKETCH]
    schema = "a bigint, b bigint" if every else "node bigint, doc bigint, partner bigint, " + ", ".join(f"{s} bigint" for s in SKETCH)

    def compare(node: np.ndarray, doc: np.ndarray, label: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        lanes = marks.view("uint8").reshape(len(node), -1)
        spare = lanes.shape[1] - TOKENS  # top bytes, always equal
        partner, near = np.full(len(node), -1), np.zeros(len(node), bool)
        found, gap = [], 1
        left = np.flatnonzero(node[:-1] == node[1:])
        while len(left):
            right = left + gap
            hit = np.count_nonzero(lanes[left] == lanes[right], axis=1) - spare >= least
            if every:
                hit &= label[left] != label[right]
                found.append((doc[left[hit]], doc[right[hit]]))
            else:
                near[left[hit]] = near[right[hit]] = True
                partner[right[hit]] = left[hit]  # the last write has the widest gap: the first of the node
            gap += 1
            left = left[left + gap < len(node)]
            left = left[node[left] == node[left + gap]]
        if every:
            a, b = (np.concatenate(x) if found else np.zeros(0, "int64") for x in (zip(*found) if found else ((), ())))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
        keep = np.flatnonzero(near)
        who = pa.array(doc[partner[keep]], mask=partner[keep] < 0)
        return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(doc[keep]), who, *[pa.array(marks[keep, i]) for i in range(len(SKETCH))]],
                                          names=["node", "doc", "partner", *SKETCH])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            new = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            if not len(new):
                continue
            data = new if tail is None else np.concatenate([tail, new])
            whole = np.searchsorted(data[:, 0], data[-1, 0])  # the last node may go on in the next batch
            tail = data[whole:]
            if whole:
                yield compare(data[:whole, 0], data[:whole, 1], data[:whole, 2], np.ascontiguousarray(data[:whole, 3:]))
        if tail is not None and len(tail):
            yield compare(tail[:, 0], tail[:, 1], tail[:, 2], np.ascontiguousarray(tail[:, 3:]))

    return rows.select(*names).repartition("node").sortWithinPartitions("node", "doc").mapInArrow(run, schema)


ANCHORED = 128  # documents that are compared with one copy of an anchor's text


def confirm(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose full sets have that similarity.

    Every pair brings the text of b to a copy of the text of a; an anchor with many partners has a copy for each ``ANCHORED``.
    """
    percent = round(similarity * 100)
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / ANCHORED).alias("copies"))
    dealt = materialise(pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).alias("copy")), "dealt-pairs")
    partners = dealt.join(texts, dealt["b"] == texts["doc"]).select("a", "copy", "b", "text")
    anchors = dealt.select("a", "copy").distinct().join(texts, F.col("a") == texts["doc"]).select("a", "copy", F.lit(None).cast("long").alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, own = None, np.zeros(0, "uint64")
        for batch in batches:
            for part in slices(batch, 3):
                key, first = shingles(part.column(3), width)
                found = []
                for i, (a, copy, b) in enumerate(zip(*(part.column(k).to_pylist() for k in range(3)))):
                    mine = key[first[i]:first[i + 1]]
                    if b is None:
                        anchor, own = (a, copy), mine
                        continue
                    assert anchor == (a, copy), "partners follow their anchor"
                    at = np.searchsorted(own, mine)
                    at[at == len(own)] = 0
                    both = int(np.count_nonzero(own[at] == mine)) if len(own) else 0
                    if both and 100 * both >= percent * (len(own) + len(mine) - both):
                        found.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["a", "b"])

    dealt_out = anchors.unionAll(partners).repartition("a", "copy").sortWithinPartitions("a", "copy", F.col("b").asc_nulls_first())
    return dealt_out.mapInArrow(run, "a bigint, b bigint")


KEYS = ["n_shingles", "set_a", "set_b"]


def _texts(docs: DataFrame, wanted: DataFrame, repeated: DataFrame, width: int) -> DataFrame:
    """(doc, text) of the classes in ``wanted`` (doc, rep and ``KEYS``): a text of the row that stands for the class.

    Ids that stand in several rows are told apart by the digest of their texts.
    """
    rows = pick(docs, ["doc_id", "text"])
    one = wanted.join(repeated, "rep", "left_anti").select("doc", "rep").hint("merge")  # texts are dealt by id at every size
    out = rows.join(one, rows["doc_id"] == one["rep"]).select("doc", "text")
    if not repeated.head(1):
        return out

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, first = shingles(batch.column(1), width)
        digest = _digests(key, first)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.diff(first)), pa.array(digest[0]), pa.array(digest[1]), batch.column(1)],
                                          names=["rep", *KEYS, "text"])

    told = over_arrow(rows.join(repeated, rows["doc_id"] == repeated["rep"], "left_semi"), ["doc_id", "text"], run,
                      "rep bigint, n_shingles bigint, set_a bigint, set_b bigint, text string")
    return out.unionAll(told.join(wanted, ["rep", *KEYS]).select("doc", "text").dropDuplicates(["doc"]))


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents are linked if intersection / union of their sets of ``width``-word shingles is ``similarity`` or more (in whole
    percent); component_id is the smallest doc_id that links reach. Null or wordless text: an empty set, linked with nothing.
    Null id: linked with nothing, component_id null, kept. Repeated rows: the same result each. Rows of one id with different
    texts: each row by its own text, and all of them as one document, so what any of them is linked with is in one component.
    Empty table: no rows. Extra columns are ignored.
    """
    least = least_equal(similarity)
    base = materialise(signatures(docs, width), "signatures")
    usable = base.filter("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy(*KEYS).agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens"))
    classes = materialise(classes.withColumn("doc", F.monotonically_increasing_id()), "classes")
    repeated = materialise(base.filter("doc_id is not null").groupBy(F.col("doc_id").alias("rep")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("rep"), "repeated-ids")
    reps = classes.select("doc", "tokens")

    sketched = materialise(reps.select("doc", *sketch()), "sketches")
    small, dense, near_pivots = _nodes(reps, sketched, least)
    near = materialise(compare_nodes(small.join(sketched, "doc").withColumn("label", F.col("doc")), least, False), "near-rows")
    dense = materialise(dense, "dense-rows")
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    likely = near.filter("partner is not null").select(F.col("partner").alias("a"), F.col("doc").alias("b")).unionAll(near_pivots)
    likely = materialise(likely.filter("a <> b").select(*pair).distinct(), "likely-pairs")
    first = materialise(likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first-pairs")
    wanted = near.select("doc").unionAll(dense.select("doc")).distinct()
    wanted = materialise(wanted.join(classes.select("doc", "rep", *KEYS), "doc"), "wanted")
    texts = co_located(_texts(docs, wanted, repeated, width), "candidate_texts", "doc")
    labels = materialise(components(confirm(first, texts, width, similarity)), "labels")
    ends = [labels.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"]
    apart = likely.join(first, ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left").filter("coalesce(ra, a) <> coalesce(rb, b)")
    again = materialise(confirm(materialise(apart.select("a", "b"), "apart-pairs"), texts, width, similarity), "apart-links")
    if again.head(1):
        labels = materialise(_merged(labels, again), "labels")

    label = F.coalesce("root", "doc").alias("label")
    rest = compare_nodes(near.join(labels, near["doc"] == labels["id"], "left").select("node", "doc", label, *SKETCH), least, True)
    rest = materialise(rest.filter("a <> b").select(*pair).distinct().join(likely, ["a", "b"], "left_anti"), "second-pairs")
    dense = dense.join(labels, dense["doc"] == labels["id"], "left").select("node", "doc", label)
    more = materialise(confirm(rest, texts, width, similarity).unionAll(_across(dense, texts, width, similarity)), "second-links")
    discard(texts, sketched, near)
    roots = _merged(labels, more) if more.head(1) else labels

    lowest = roots.join(classes.select(F.col("doc").alias("id"), "rep"), "id").groupBy("root").agg(F.min("rep").alias("lowest"))
    named = roots.join(lowest, "root").select(F.col("id").alias("doc"), "lowest")
    named = classes.select("doc", "rep", *KEYS).join(named, "doc", "left").select(*KEYS, F.coalesce("lowest", "rep").alias("reached"))
    own = F.when(F.col("n_shingles") > 0, F.coalesce("reached", "doc_id")).otherwise(F.col("doc_id"))
    out = base.select("doc_id", *KEYS).join(named, KEYS, "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), own))
    if repeated.head(1):
        out = _one_document(out, repeated)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _one_document(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Joins the components that rows of one id are in."""
    rows = materialise(rows, "reached")
    held = rows.join(repeated.withColumnRenamed("rep", "doc_id"), "doc_id").select("doc_id", "component_id").distinct()
    held = held.join(held.groupBy("doc_id").agg(F.min("component_id").alias("a")), "doc_id").select("a", F.col("component_id").alias("b"))
    joined = materialise(components(held), "joined").select(F.col("id").alias("component_id"), "root")
    return rows.join(joined, "component_id", "left").withColumn("component_id", F.coalesce("root", "component_id"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root) after more links: components of the roots that the links join."""
    at = labels.select(F.col("id").alias("a"), F.col("root").alias("ra")), labels.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    joined = links.join(at[0], "a", "left").join(at[1], "b", "left")
    upper = materialise(components(joined.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))), "upper-labels")
    upper = upper.select(F.col("id").alias("root"), F.col("root").alias("top"))
    moved = labels.join(upper, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    fresh = upper.join(labels.select(F.col("id").alias("root")), "root", "left_anti").select(F.col("root").alias("id"), F.col("top").alias("root"))
    return moved.unionAll(fresh)


QUERIES, MEMBERS = 256, 512  # documents of a family that one task compares


def _across(rows: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) between documents that share a dense node and are in different components.

    Dense nodes whose largest component is the same hold much the same documents, so they are taken together as a family: its
    documents outside that component are held against all of it. Both sides are dealt in blocks; a task builds an inverted list
    of the full sets of one block of outsiders and runs the members past it, so pairs are counted but never formed as rows.
    """
    percent = round(similarity * 100)
    rows = materialise(rows, "labelled-rows")
    size = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
    most = size.groupBy("node").agg(F.max_by("label", F.struct("n", "label")).alias("family"))
    members = materialise(rows.join(most, "node").groupBy("family", "doc").agg(F.min("label").alias("label")), "families")
    outside = F.count_if(F.col("label") != F.col("family"))
    shape = members.groupBy("family").agg(F.ceil(outside / QUERIES).cast("int").alias("blocks"), F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("salts"))
    members = members.join(shape.filter("blocks > 0"), "family")
    dealt = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int").alias(n[:-1])
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(n[:-1])
    asked = members.filter("label <> family").select("family", dealt("blocks"), spread("salts"), F.lit(0).alias("role"), "doc", "label")
    held = members.select("family", spread("blocks"), dealt("salts"), F.lit(1).alias("role"), "doc", "label")
    both = asked.unionAll(held).join(texts, "doc").select("family", "block", "salt", "role", "doc", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, queries, index, met = None, [], None, set()
        for batch in batches:
            for part in slices(batch, 6):
                key, first = shingles(part.column(6), width)
                found = []
                for i, (family, block, salt, role, doc, label) in enumerate(zip(*(part.column(k).to_pylist() for k in range(6)))):
                    if group != (family, block, salt):
                        group, queries, index, met = (family, block, salt), [], None, set()
                    mine = key[first[i]:first[i + 1]]
                    if role == 0:
                        queries.append((doc, label, mine))
                        continue
                    if not queries:
                        continue
                    if index is None:
                        keys = np.concatenate([q[2] for q in queries])
                        order = np.argsort(keys, kind="stable")
                        index = keys[order], np.repeat(np.arange(len(queries)), [len(q[2]) for q in queries])[order], np.array([len(q[2]) for q in queries])
                    left, right = (np.searchsorted(index[0], mine, side=side) for side in ("left", "right"))
                    n = right - left
                    at = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    common = np.bincount(index[1][at], minlength=len(queries))
                    close = (common > 0) & (100 * common >= percent * (index[2] + len(mine) - common))
                    for q in np.flatnonzero(close).tolist():
                        if queries[q][1] != label and (q, label) not in met:  # one link joins the query to all of a component
                            met.add((q, label))
                            found.append((queries[q][0], doc))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["a", "b"])

    keys = ["family", "block", "salt"]
    return both.repartition(*keys).sortWithinPartitions(*keys, "role").mapInArrow(run, "a bigint, b bigint")
