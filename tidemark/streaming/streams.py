"""Streaming forms of resampling, de-duplication, availability gating and indicator state.

Every query runs with ``availableNow`` over a growing folder, keeps its state
and progress under the shared checkpoint folder and writes to Parquet, so no
result passes through the driver and a lost executor only repeats a batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.session import materialise, scratch_path
from tidemark.sources.tables import SCHEMAS


def as_instant(wall: Column) -> Column:
    """Stored wall-clock time read as UTC, whatever the session time zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), wall).cast("timestamp")


def as_wall(instant: Column) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The stored event files as a stream with an event-time column."""
    rows = spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(folder)
    return rows.withColumn("at", as_instant(F.col("ts")))


def run_to_table(out: DataFrame, label: str, close: Callable[[], None] | None = None) -> DataFrame:
    """Drain the stream into a Parquet table in the shared folder and open it."""
    return out.sparkSession.read.schema(out.schema).parquet(drain(out, label, close)[0])


def drain(out: DataFrame, label: str, close: Callable[[], None] | None = None) -> tuple[str, str]:
    """Run the stream until its source is exhausted; returns the folders of its output and of its progress and state.

    With ``close`` (see ``closable``) the stream is then told that no more rows come, and gives out what was still open.
    """
    spark = out.sparkSession
    path, progress = scratch_path(spark, label), scratch_path(spark, f"{label}-progress")

    def run() -> None:
        writer = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", progress).option("path", path)
        writer.trigger(availableNow=True).start().awaitTermination()

    run()
    if close is not None:
        close()
        run()
    return path, progress


def closable(events: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """The stream and a function that closes it: a last row in the far future, with all other columns null, moves the watermark
    past every open window. Its own window is never given out."""
    spark = events.sparkSession
    side = scratch_path(spark, "closing")
    spark.createDataFrame([], events.schema).coalesce(1).write.parquet(side)

    def close() -> None:
        last = [F.lit("9000-01-01").cast("timestamp").alias(c) if c == "at" else F.lit(None).cast(t).alias(c) for c, t in events.dtypes]
        spark.range(1).select(*last).coalesce(1).write.mode("append").parquet(side)

    return events.unionByName(spark.readStream.schema(events.schema).parquet(side)), close


def tumbling_bars(events: DataFrame, key: str, hours: int, delay: str) -> DataFrame:
    """Bars of ``hours`` hours from hourly slots; a window that misses a slot never appears.

    Which slots were seen is a bit mask, so one aggregation and one state row per
    window are enough. Windows close when the watermark passes them.
    """
    slot = F.expr(f"shiftleft(1, hour(ts) % {hours})")
    g = events.withWatermark("at", delay).groupBy(key, F.window("at", f"{hours} hours")).agg(
        F.min_by("value", "event_id").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "event_id").alias("close"),
        F.count(F.lit(1)).alias("volume"),
        F.bit_or(slot).alias("_seen"),
    )
    full = g.filter(F.col("_seen") == 2**hours - 1)
    return full.select(
        key,
        as_wall(F.col("window.start")).alias("bar_start"),
        as_wall(F.col("window.end")).alias("bar_end"),
        "open", "high", "low", "close", "volume",
    )


class SeenKeys:
    """Distinct keys of a stream of re-deliveries, however far apart the copies are.

    No streaming state: the keys seen so far are a table, bucketed by key and partitioned by micro-batch. A batch takes its distinct
    keys that no earlier batch has stored and writes them as its own partition, replacing it if the batch is run again, so a
    repeated batch stores nothing twice. Stored keys are not shuffled, their buckets are joined where they lie.
    """

    def __init__(self, spark: SparkSession, keys: list[tuple[str, str]], buckets: int = 16):
        self.keys = [name for name, _ in keys]
        self.name = f"seen_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{name}` {kind}" for name, kind in keys)
        spark.sql(f"CREATE TABLE {self.name} (token STRING, {columns}, batch BIGINT) USING parquet PARTITIONED BY (batch) "
                  f"CLUSTERED BY (token) SORTED BY (token) INTO {buckets} BUCKETS LOCATION '{scratch_path(spark, 'seen-keys')}'")

    def absorb(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        token = F.to_json(F.struct(*self.keys), {"ignoreNullFields": "false"})  # nulls are equal to each other
        stored = spark.table(self.name).filter(F.col("batch") < number).select("token")
        fresh = batch.select(token.alias("token"), *self.keys).dropDuplicates(["token"]).join(stored, "token", "left_anti")
        view = f"{self.name}_{number}"
        materialise(fresh, "fresh-keys").createOrReplaceTempView(view)  # a table cannot be read and overwritten in one statement
        spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = {number}) SELECT token, {', '.join(f'`{k}`' for k in self.keys)} FROM {view}")
        spark.catalog.dropTempView(view)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name).select(*self.keys)


def distinct_revisions(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each distinct ``keys`` of the drained stream once."""
    spark = events.sparkSession
    kinds = dict(events.dtypes)
    seen = SeenKeys(spark, [(k, kinds[k]) for k in keys])
    progress = scratch_path(spark, "dedup-progress")
    query = events.select(*keys).writeStream.foreachBatch(seen.absorb).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    return seen.table(spark)


DAY_MS = 86_400_000
GATED = "event_id bigint, subject string, day bigint, late boolean, open boolean"


class Gate(StatefulProcessor):
    """Holds the rows of a bucket of subjects and a day in state until the watermark passes the day's end, then routes them by
    the first instant of their subject.

    A row that arrives after that, for a day told or never heard of, is late and is given out at once. A group is a bucket, not a
    subject, since each group costs some round trips to the state store. Rows are a list of pieces there, as they came in Arrow
    batches, so a busy day is never one object in memory; only the first instants of a bucket's subjects are.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "event_id array<bigint>, subject array<string>, at array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        end = (key[1] + 1) * DAY_MS
        if end <= timerValues.getCurrentWatermarkInMs():
            for chunk in rows:
                yield self._routed(key, chunk["event_id"], chunk["subject"], True)
            return
        for chunk in rows:
            self.rows.appendValue((chunk["event_id"].tolist(), chunk["subject"].tolist(), chunk["at"].tolist()))
        self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first: dict[str, int] = {}
        for _, subjects, at in self.rows.get():
            for subject, t in zip(subjects, at):
                if t < first.get(subject, t + 1):
                    first[subject] = t
        for ids, subjects, at in self.rows.get():
            yield self._routed(key, pd.Series(ids), pd.Series(subjects), pd.Series([t > first[s] for s, t in zip(subjects, at)]))
        self.rows.clear()

    @staticmethod
    def _routed(key, ids: pd.Series, subjects: pd.Series, late: pd.Series | bool) -> pd.DataFrame:
        return pd.DataFrame({"event_id": ids, "subject": subjects, "day": key[1], "late": late, "open": False})

    def close(self) -> None:
        pass


def gate_late(events: DataFrame, delay: str, buckets: int = 64) -> DataFrame:
    """(event_id, user_id, day, late, open) of every row: late if it became known after its (subject, day) group's first row.

    Groups are told when the watermark passes the day's end; until then an earlier row still moves the decision point, after that
    nothing is rewritten. Rows of days still open when the source is exhausted are read from the state store and marked ``open``,
    with ``late`` as far as is known. No row is in no output or in two. Subjects share ``buckets`` groups a day.
    """
    spark = events.sparkSession
    at = F.unix_micros("at")
    # the processor gets the time as a number: Spark itself drops rows behind the watermark where the time column goes on;
    # and subjects as text, null as an empty one
    subject = F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("subject")
    rows = events.withWatermark("at", delay).select("event_id", subject, F.floor(at / (DAY_MS * 1000)).alias("day"), at.alias("at"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("subject"), F.lit(buckets)))
    with _rocksdb(spark):
        out = rows.groupBy("bucket", "day").transformWithStateInPandas(
            statefulProcessor=Gate(), outputStructType=GATED, outputMode="Append", timeMode="EventTime")
        path, progress = drain(out, "gate")
    told = spark.read.schema(GATED).parquet(path)
    held = spark.read.format("statestore").option("stateVarName", "rows").load(progress).select("key.day", F.explode(F.arrays_zip(
        *[F.col(f"list_element.{c}").alias(c) for c in ("event_id", "subject", "at")])).alias("r")).select("day", "r.*")
    first = held.groupBy("subject", "day").agg(F.min("at").alias("first"))
    open_ = held.join(first, ["subject", "day"]).select("event_id", "subject", "day", (F.col("at") > F.col("first")).alias("late"), F.lit(True).alias("open"))
    named = F.when(F.col("subject") != "", F.col("subject")).cast("bigint").alias("user_id")
    return told.unionByName(open_).select("event_id", named, F.date_from_unix_date(F.col("day").cast("int")).alias("day"), "late", "open")


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which stateful processors need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def indicator_state(alpha: float) -> Callable:
    """Per-key update of an exponential average and on-balance volume, in bar order."""

    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(chunks), ignore_index=True).sort_values("bar_start", ignore_index=True)
        x, v = rows["close"], rows["volume"].astype(float)
        if state.exists:
            ema, obv, last = state.get
            seen = pd.concat([pd.Series([ema]), x], ignore_index=True)
            line = seen.ewm(alpha=alpha, adjust=False).mean().iloc[1:].to_numpy()
            change = x.diff().fillna(x.iloc[0] - last)
            total = obv + (np.sign(change) * v).cumsum()
        else:
            line = x.ewm(alpha=alpha, adjust=False).mean().to_numpy()
            signed = np.sign(x.diff()) * v
            signed.iloc[0] = v.iloc[0]
            total = signed.cumsum()
        state.update((float(line[-1]), float(total.iloc[-1]), float(x.iloc[-1])))
        yield rows[["instrument", "bar_start"]].assign(ema=line, obv=total.to_numpy())

    return update


STATE = "ema double, obv double, last double"
STATE_OUT = "instrument bigint, bar_start timestamp, ema double, obv double"


def incremental_indicators(bars: DataFrame, period: int) -> DataFrame:
    """EMA and OBV carried across batches of (instrument, bar_start, close, volume).

    The input is bars, not ticks: a batch holds at most one row per instrument
    and time slot, whatever the number of ticks behind it.
    """
    return bars.groupBy("instrument").applyInPandasWithState(
        indicator_state(2 / (period + 1)), STATE_OUT, STATE, "append", GroupStateTimeout.NoTimeout
    )
