import collections
import hashlib
import random
import zlib

import duckdb
import pytest

from tidemark.llm import trie as T
from tidemark.llm.queries import op11

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), key, role, text))
    return {c: [t[2:] for t in sorted(v)] for c, v in own.items()}


def brute(convs):
    """Nodes from every prefix of every conversation."""
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 4 * n), n):
        text = ["system prompt", "é" * 5, ""]
        for turn in range(rng.choice([0, 1, 2, 3, 6, 12])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), text[turn] if turn < 3 and rng.random() < 0.8 else rng.choice(["a", "b", "c" * 300, None])))
    rows += [(c, t, "system", f"same {t}") for c in range(9000, 9060) for t in range(5)]  # a large group of equal conversations
    rows += [(8000 + c, t, "user", "go on" if t < 7 else str(c)) for c in range(12) for t in range(9)]  # a long shared beginning
    rows += [(None, 1, "user", "x"), (7000, None, "user", "first"), (7000, 0, "user", "second"), (7001, 3, "b", "tie"), (7001, 3, "a", "tie"), rows[0], rows[1]]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def table(spark):
    rows = corpus(3, 60)
    return rows, spark.createDataFrame([(*r, 5, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, head int, path string").repartition(5)


@pytest.mark.parametrize("container, chunk", [(2048, 1 << 16), (2, 16)])
def test_nodes_equal_brute_force(spark, monkeypatch, table, container, chunk):
    monkeypatch.setattr(T, "CONTAINER", container)
    monkeypatch.setattr(T, "CHUNK", chunk)
    rows, df = table
    got = sorted((tuple(r) for r in T.prefix_trie(T.paths(df)).select(*COLUMNS).collect()), key=repr)
    assert got == brute(ordered(rows))


def test_containers_burst_by_bytes(spark, monkeypatch, table):
    monkeypatch.setattr(T, "CONTAINER_BYTES", 400)
    rows, df = table
    assert sorted((tuple(r) for r in T.prefix_trie(T.paths(df)).select(*COLUMNS).collect()), key=repr) == brute(ordered(rows))


def test_rebuilt_conversations(spark, table):
    rows, df = table
    own = ordered(rows)
    want = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c / 5) * 5
        want[c] = own.get(c - base, [])[:h] + turns[h:]
    got = sorted((tuple(r) for r in T.prefix_trie(op11.rebuilt(df)).select(*COLUMNS).collect()), key=repr)
    assert got == brute(want)
    assert any(not t for t in want.values())


def test_sql_and_spark_agree(spark, folder):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet'")
    want = sorted(con.execute(f"select {', '.join(COLUMNS)} from ({op11.SQL})").fetchall(), key=repr)
    assert sorted((tuple(r) for r in op11.op11(spark, folder).select(*COLUMNS).collect()), key=repr) == want


def test_empty_table_and_turnless_conversations(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert T.prefix_trie(T.paths(empty)).count() == 0
    bare = spark.createDataFrame([(5, b""), (3, b"")], "conv_id bigint, path binary")
    assert [tuple(r) for r in T.prefix_trie(bare).select(*COLUMNS).collect()] == brute({5: [], 3: []})
