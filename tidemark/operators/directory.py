"""Search over a directory of securities by several alias columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

GRAM = 3
FEW = 100_000  # terms that every task can hold


def search_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text.cast("string"), r"^\s+|\s+$", ""))


def search(rows: DataFrame, id: str, columns: Sequence[str], term: str) -> DataFrame:
    """Ranked matches: 0 exact, 1 prefix, 2 contains; the best alias of an entry counts."""
    t = term.strip().lower()

    def rank(c: str) -> Column:
        k = search_key(F.col(c))
        return F.when(k == t, 0).when(k.startswith(t), 1).when(F.contains(k, F.lit(t)), 2)

    best = F.array_min(F.array_compact(F.array(*[rank(c) for c in columns])))
    return rows.select(id, best.alias("rank")).filter("rank is not null")


def initials(name: Column) -> Column:
    """First letters of the words of a name."""
    return F.array_join(F.transform(F.filter(F.split(search_key(name), r"\s+"), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), "")


def _grams(text: Column, size: Column) -> Column:
    """Distinct substrings of that many letters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)))


def gram_index(rows: DataFrame, id: str, columns: Sequence[str]) -> DataFrame:
    """(gram, id, key): every alias under each of its substrings of 1 to ``GRAM`` letters."""
    keys = rows.select(id, F.explode(F.array_distinct(F.array(*[search_key(F.col(c)) for c in columns]))).alias("key")).filter("key <> ''")
    sizes = F.filter(F.array(*[F.lit(n) for n in range(1, GRAM + 1)]), lambda n: n <= F.length("key"))
    return keys.select(id, "key", F.explode(F.flatten(F.transform(sizes, lambda n: _grams(F.col("key"), n)))).alias("gram"))


def search_terms(rows: DataFrame, id: str, columns: Sequence[str], terms: DataFrame, term: str = "term") -> DataFrame:
    """(term, rank, position, id) of all matches of a table of terms, ranked 0 exact, 1 prefix, 2 contains, then by id.

    Each term looks up the rarest of its substrings of ``GRAM`` letters (or itself, if it is shorter) and is held against the
    aliases found there, so no term reads the whole directory. These substrings are stored first: ``FEW`` of them at most
    go to the index, which is then not shuffled. Terms are compared trimmed and in small letters; null and blank ones find nothing.
    """
    index = gram_index(rows, id, columns)
    asked = terms.select(search_key(F.col(term)).alias("term")).filter("term <> ''").distinct()
    size = F.least(F.lit(GRAM), F.length("term"))
    pieces = asked.select("term", F.explode(_grams(F.col("term"), size)).alias("gram"))
    held = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = pieces.join(held.hint("merge"), "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m"))
    rarest = materialise(rarest.filter("m.n > 0").select("term", F.col("m.gram").alias("gram")), "rarest-grams")
    # the plan takes the index for as small as the directory's files and would broadcast it
    few = rarest.limit(FEW + 1).count() <= FEW
    near = rarest.hint("broadcast" if few else "merge").join(index, "gram").filter(F.contains("key", "term"))
    rank = F.when(F.col("key") == F.col("term"), 0).when(F.startswith("key", "term"), 1).otherwise(2)
    best = near.groupBy("term", id).agg(F.min(rank).alias("rank"))
    return best.withColumn("position", F.row_number().over(Window.partitionBy("term").orderBy("rank", id)))


def aliases(rows: DataFrame, id: str, columns: Sequence[str]) -> DataFrame:
    """Each alias with the number of entries behind it; more than one is ambiguous."""
    keys = rows.select(id, F.explode(F.array_distinct(F.array(*[search_key(F.col(c)) for c in columns]))).alias("alias"))
    return keys.groupBy("alias").agg(F.count(F.lit(1)).alias("matches")).withColumn("ambiguous", F.col("matches") > 1)
