"""Stored market tables: declared schemas, pruned scans, digests, quarantine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAILY = ("instrument bigint, session_date date, open double, high double, low double, close double, volume double, "
         "amount double, price_basis string")
MINUTE = ("instrument string, day date, bar_start timestamp_ntz, open double, high double, low double, close double, "
          "volume bigint, amount decimal(24,4)")
SESSIONS = ("instrument bigint, session_date date, board string, trading_status string, previous_close double, "
            "upper_limit decimal(18,2), lower_limit decimal(18,2), is_st boolean")
ACTIONS = ("instrument bigint, action_id bigint, kind string, record_date date, ex_date date, gross_cash double, "
           "multiplier double")
EVENTS_V1 = "event_id bigint, user_id bigint, day date, event_type string"
EVENTS_V2 = EVENTS_V1 + ", attributes_json string"

FUND_FLOW = ("trade_date", "main", "small", "medium", "large", "extra_large", "main_pct", "small_pct", "medium_pct",
             "large_pct", "extra_large_pct", "close", "change_pct")


def names(schema: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in schema.split(", ")]


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Project and cast to a declared schema; a missing column is an error."""
    missing = [n for n in names(schema) if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing for the declared schema: {missing}")
    types = [part.strip().split(" ", 1) for part in schema.split(", ")]
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in types])


def write(df: DataFrame, path: str, schema: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """Parquet with a declared schema; rows are sorted inside files so row groups prune."""
    out = conform(df, schema)
    if partition_by:
        out = out.repartition(*partition_by, *[c for c in sort_by[:1] if c not in partition_by])
    if sort_by:
        out = out.sortWithinPartitions(*sort_by)
    w = out.write.mode("error")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def scan(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    df = spark.read.schema(schema).parquet(path)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def span(column: str, start: str, end: str, kind: str = "date") -> Column:
    """Half-open range that reaches the Parquet reader as two comparisons."""
    return (F.col(column) >= F.lit(start).cast(kind)) & (F.col(column) < F.lit(end).cast(kind))


def unique_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows as they are, or an error that names a key of which there are several."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(c) for c in rest])
    twice = F.raise_error(F.concat(F.lit("duplicate key: "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys])))
    return g.filter(F.when(F.col("_n") == 1, F.lit(True)).otherwise(twice.cast("boolean"))).select(*df.columns)


def scan_bars(spark: SparkSession, path: str, columns: Sequence[str], basis: str, start: str, end: str, instruments: Sequence[int] | None = None) -> DataFrame:
    """Daily bars of one price basis in a half-open range, of all or some instruments; a bar stored twice is an error.

    Basis, range and instruments are plain comparisons on stored columns, so partitions and row groups are pruned.
    """
    where = (F.col("price_basis") == basis) & span("session_date", start, end)
    if instruments is not None:
        where = where & F.col("instrument").isin(*instruments)
    return unique_rows(scan(spark, path, DAILY, columns, where), ["instrument", "session_date"])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def scan_events(spark: SparkSession, path: str) -> DataFrame:
    """Newer files carry attributes, older ones do not; the footer decides the projection."""
    have = set(spark.read.parquet(path).columns)
    schema = EVENTS_V2 if "attributes_json" in have else EVENTS_V1
    df = spark.read.schema(schema).parquet(path)
    return df if "attributes_json" in have else df.withColumn("attributes_json", F.lit(None).cast("string"))


def all_or_none(columns: Sequence[str], optional: Sequence[str]) -> bool:
    """Optional column groups must be present together or not at all."""
    n = sum(c in columns for c in optional)
    if n not in (0, len(optional)):
        raise ValueError(f"partial column group: {sorted(set(optional) & set(columns))}")
    return n > 0


def row_digest(parts: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each with its length in front and NULL told apart, so no two field lists read alike."""
    texts = [p.cast("string") for p in parts]
    return F.sha2(F.concat_ws("|", *[F.when(t.isNull(), "N").otherwise(F.concat_ws(":", F.length(t), t)) for t in texts]), 256)


def fingerprint(df: DataFrame, parts: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Content digest that ignores the order of rows but not how often they occur: row count and four sums of digest words."""
    words = df.withColumn("_digest", row_digest(parts))
    sums = [F.sum(F.conv(F.substring("_digest", 15 * i + 1, 15), 16, 10).cast("decimal(19,0)")).cast("decimal(38,0)") for i in range(4)]
    digest = F.concat_ws("-", *[F.coalesce(s, F.lit(0)).cast("string") for s in sums])
    return words.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), digest.alias("digest"))


MANIFEST = "_manifest"


def write_manifest(spark: SparkSession, path: str, schema: str, parts: Sequence[Column], keys: dict[str, Column] | None = None) -> DataFrame:
    """Fingerprint what was written under ``path`` and keep it beside the data, in a folder that Parquet readers pass over."""
    keys = keys or {}
    fingerprint(scan(spark, path, schema).withColumns(keys), parts, list(keys)).write.mode("error").json(f"{path}/{MANIFEST}")
    return read_manifest(spark, path, {k: "int" for k in keys})


def read_manifest(spark: SparkSession, path: str, keys: dict[str, str]) -> DataFrame:
    return spark.read.schema(", ".join([*(f"{k} {t}" for k, t in keys.items()), "rows bigint", "digest string"])).json(f"{path}/{MANIFEST}")


def split_quarantine(df: DataFrame, good: Column, path: str) -> tuple[DataFrame, DataFrame]:
    """Write accepted and rejected rows in one pass, to two folders under ``path``; returns both."""
    df.withColumn("accepted", F.coalesce(good, F.lit(False))).write.partitionBy("accepted").parquet(path)
    both = df.sparkSession.read.schema(df.schema.add("accepted", "boolean")).parquet(path)
    return both.filter("accepted").drop("accepted"), both.filter("not accepted").drop("accepted")


def parse_fund_flow(lines: DataFrame) -> DataFrame:
    """Thirteen comma-separated fields per line; ``problem`` names what is wrong with a line."""
    f = F.split("value", ",")
    d = [F.try_element_at(f, F.lit(i + 1)) for i in range(13)]
    numbers = [x.try_cast("decimal(24,4)") for x in d[1:]]
    df = lines.select(
        "value", F.size(f).alias("_n"), d[0].try_cast("date").alias("trade_date"),
        *[x.alias(n) for n, x in zip(FUND_FLOW[1:], numbers)],
    )
    unreadable = F.lit(False)
    for n in FUND_FLOW[1:]:
        unreadable = unreadable | F.col(n).isNull()
    parts = F.col("large") + F.col("extra_large")
    tolerance = F.greatest(F.lit(1.0), F.greatest(F.abs("main"), F.abs(parts), F.lit(1)) * 0.0001)
    problem = (
        F.when(F.col("_n") != 13, "field_count")
        .when(F.col("trade_date").isNull(), "date")
        .when(unreadable, "number")
        .when(F.col("close") <= 0, "close")
        .when(F.abs(F.col("main") - parts) > tolerance, "identity")
    )
    return df.withColumn("problem", problem).drop("_n")


def minute_export(rows: DataFrame, also: Column | None = None) -> DataFrame:
    """User export: prices rounded past their binary tail, volumes must be whole shares; rows for which ``also`` holds are rejected too."""
    p = {c: F.round(c, 6).cast("decimal(20,6)").alias(c) for c in ("open", "high", "low", "close")}
    whole = F.col("vol") == F.floor("vol")
    return rows.select("ts_code", "trade_time", *p.values(), F.when(whole, F.col("vol")).cast("long").alias("volume"),
                       F.col("amount").cast("decimal(24,4)").alias("amount"), (~whole if also is None else ~whole | also).alias("rejected"))


MINUTES = ("ts_code string, trade_date date, trade_time timestamp_ntz, open double, high double, low double, close double, vol double, amount double, "
           "month string")


def write_minutes(rows: DataFrame, path: str) -> None:
    """Store exported minute rows so that one symbol and range reads little: a folder a month, files that are ranges of symbol and
    time, rows in that order, and a bloom filter on the symbol in every row group."""
    order = ["month", "ts_code", "trade_time"]
    dated = rows.withColumn("month", F.date_format("trade_date", "yyyy-MM")).select(*names(MINUTES))
    (dated.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("month").option("parquet.bloom.filter.enabled#ts_code", "true")
     .option("parquet.bloom.filter.expected.ndv#ts_code", "10000").parquet(path))


def read_minutes(spark: SparkSession, path: str, symbol: str, start: str, end: str) -> DataFrame:
    """Checked rows of one symbol from ``start`` to ``end``, both included. Months are pruned, symbol and dates go down to the scan.

    ``rejected`` also where the date and the time of a row are of different days.
    """
    if start > end:
        raise ValueError("start lies behind end")
    rows = spark.read.schema(MINUTES).parquet(path)
    day = F.col("trade_date")
    wanted = rows.filter(F.col("month").between(start[:7], end[:7]) & (F.col("ts_code") == symbol) & day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return minute_export(wanted, F.to_date("trade_time") != F.col("trade_date"))


def load_store(spark: SparkSession, paths: Mapping[str, str], schemas: Mapping[str, str], dates: Mapping[str, str]) -> dict[str, DataFrame]:
    """Open the tables of a market store and derive ``date_int`` on the dated ones."""
    out = {}
    for name, path in paths.items():
        df = spark.read.schema(schemas[name]).parquet(path)
        if name in dates:
            df = df.withColumn("date_int", F.date_format(dates[name], "yyyyMMdd").cast("int"))
        out[name] = df
    return out
