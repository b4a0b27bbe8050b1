import random

from tidemark.operators import directory as D


def test_terms_equal_a_full_scan(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice("abÄ") for _ in range(rng.randint(1, 5))) for _ in range(2)), rng.choice([None, "X1", " Ab "])) for i in range(200)]
    terms = [None, "", " ", "a", "Ab", "bä", "aba b", "x1", "zzz", *["".join(rng.choice("abÄ ") for _ in range(rng.randint(1, 6))) for _ in range(60)]]
    df = spark.createDataFrame(rows, "symbol int, name string, code string")
    got = {(r["term"], r["position"]): (r["rank"], r["symbol"]) for r in D.search_terms(df, "symbol", ["name", "code", "symbol"], spark.createDataFrame([(t,) for t in terms], "t string"), "t").collect()}
    want = {}
    for t in {(t or "").strip().lower() for t in terms} - {""}:
        found = []
        for symbol, name, code in rows:
            keys = [k.strip().lower() for k in (name, code, str(symbol)) if k is not None]
            ranks = [0 if k == t else 1 if k.startswith(t) else 2 for k in keys if t in k]
            if ranks:
                found.append((min(ranks), symbol))
        want |= {(t, n): f for n, f in enumerate(sorted(found), 1)}
    assert got == want and len(want) > 300


def test_initials(spark):
    df = spark.createDataFrame([("  Dark  red Wine ",), ("x",), ("",), (None,)], "n string")
    from pyspark.sql import functions as F

    assert [r["i"] for r in df.select(D.initials(F.col("n")).alias("i")).collect()] == ["drw", "x", "", None]


def test_index_is_never_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"name {i}") for i in range(50)], "symbol int, name string")
    terms = spark.createDataFrame([(x,) for x in ("ame", "me 7", *"0123456789")], "t string")
    found = []
    for few in (D.FEW, 3):
        monkeypatch.setattr(D, "FEW", few)
        out = D.search_terms(df, "symbol", ["name"], terms, "t")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan, "SortMergeJoin" in plan) == (few > 3, few <= 3) and "BuildRight" not in plan
        found.append(sorted(map(tuple, out.collect())))
    assert found[0] == found[1] and len(found[0]) > 51
