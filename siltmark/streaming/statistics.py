"""Running class statistics over a stream."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from siltmark.streaming.candidates import event_time

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prototype_stream(df: DataFrame, value: str = "value", label: str = "label") -> DataFrame:
    """Count, sum and sum of squares per class. Partial sums combine before the state, so a
    class with most of the rows costs its task one row per input task."""
    v = F.col(value).cast("double")
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n_rows"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"))


def complete_table(df: DataFrame, path: str, mode: str = "complete") -> StreamingQuery:
    """Keep one Parquet version of the result per batch; a repeated batch rewrites its own.

    In ``update`` mode a version holds only the keys that changed (see ``latest_values``).
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/version={batch_id}")

    return (
        df.writeStream.outputMode(mode)
        .foreachBatch(save)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def last_version(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.parquet(f"{path}/table")
    last = table.agg(F.max("version")).head()[0]
    return table.where(F.col("version") == last).drop("version")


def latest_values(spark: SparkSession, path: str, keys: list[str], values: list[str], closed: str | None = None) -> DataFrame:
    """The newest row of every key over all versions written in ``update`` mode. Keys whose newest
    row is a tombstone (``closed`` is set) have left."""
    table = spark.read.parquet(f"{path}/table")
    newest = F.max_by(F.struct(*values, *([closed] if closed else [])), "version").alias("_v")
    found = table.groupBy(*keys).agg(newest).select(*keys, "_v.*")
    return found.where(~F.col(closed)).drop(closed) if closed else found


@contextmanager
def expiring_state(spark: SparkSession) -> Iterator[None]:
    """Session settings for a drained query with expiring state; restored afterwards."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class _RunningSums(StatefulProcessor):
    """Sums per (class, salt) with a time to live, for classes that may fall silent."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "n bigint, total double, squares double", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        n, total, squares = self.sums.get() if self.sums.exists() else (0, 0.0, 0.0)
        for part in rows:
            v = part["value"].astype(float)
            n, total, squares = n + len(v), total + float(v.sum()), squares + float((v * v).sum())
        self.sums.update((n, total, squares))
        yield pd.DataFrame({"label": [key[0]], "salt": [key[1]], "n_rows": [n], "total": [total], "squares": [squares]})

    def close(self) -> None:
        pass


def expiring_sums(df: DataFrame, value: str = "value", label: str = "label", ttl_ms: int | None = None, salts: int = 16, row_id: str = "row_id") -> DataFrame:
    """Like ``prototype_stream`` with state that expires. Classes are split over ``salts``
    keys, so a hot class is spread; readers add the latest rows of each (label, salt).

    Needs the RocksDB state store. With a time to live Spark keeps running empty batches to
    expire state, so a run that should end by itself switches those off (``expiring_state``).
    """
    keyed = df.select(
        F.col(label).cast("string").alias("label"),
        F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int").alias("salt"),
        F.col(value).cast("double").alias("value"),
    )
    return keyed.groupBy("label", "salt").transformWithStateInPandas(
        _RunningSums(ttl_ms), "label string, salt int, n_rows bigint, total double, squares double", "Update", "ProcessingTime" if ttl_ms else "None"
    )


class _TimedSums(StatefulProcessor):
    """Sums per (class, salt) until it has been silent for some event time; then a tombstone."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n bigint, total double, squares double, last bigint")

    def _row(self, key, n, total, squares, closed) -> pd.DataFrame:
        return pd.DataFrame({"label": [key[0]], "salt": [key[1]], "n_rows": [n], "total": [total], "squares": [squares], "closed": [closed]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        n, total, squares, last = self.sums.get() if self.sums.exists() else (0, 0.0, 0.0, 0)
        for part in rows:
            v = part["value"].astype(float)
            n, total, squares, last = n + len(v), total + float(v.sum()), squares + float((v * v).sum()), max(last, int(part["at"].max()))
        self.sums.update((n, total, squares, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.silence_ms)
        yield self._row(key, n, total, squares, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, total, squares, _ = self.sums.get()
        self.sums.clear()
        yield self._row(key, n, total, squares, True)

    def close(self) -> None:
        pass


def silent_sums(
    df: DataFrame, silence_ms: int, delay: str, value: str = "value", label: str = "label", salts: int = 16, row_id: str = "row_id", ts: str = "ts"
) -> DataFrame:
    """Running sums of classes that may fall silent: a part (label, salt) without a row for
    ``silence_ms`` of event time frees its state and emits a last row with ``closed`` set, so that
    readers of the versions see it leave (``latest_values``). A part that comes back starts anew.

    The time is the watermark's, so a replay gives the same tombstones. Parts fall silent one by
    one: the time should be well above the usual gap between rows of a class, times ``salts``.
    """
    timed = event_time(df, ts).withWatermark(ts, delay)
    keyed = timed.select(
        F.col(label).cast("string").alias("label"), F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int").alias("salt"), F.col(value).cast("double").alias("value"),
        F.unix_millis(ts).alias("at"), ts,
    )
    fields = "label string, salt int, n_rows bigint, total double, squares double, closed boolean"
    return keyed.groupBy("label", "salt").transformWithStateInPandas(_TimedSums(silence_ms), fields, "Update", "EventTime")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, for the queries started within the block."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)
