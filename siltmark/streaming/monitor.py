"""Windowed monitoring and progress metrics."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from siltmark.streaming.candidates import event_time


def monitor(df: DataFrame, width: str, flag: Column, delay: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows, flagged rows and rate per tumbling or sliding window; works on batch and stream."""
    timed = event_time(df, ts)
    timed = timed.withWatermark(ts, delay) if df.isStreaming else timed
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    counts = timed.groupBy(win.alias("w")).agg(F.count("*").alias("n_rows"), F.count_if(flag).alias("n_flagged"))
    return counts.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "n_rows",
        "n_flagged",
        (F.col("n_flagged") / F.col("n_rows")).alias("rate"),
    )


PROGRESS = (
    "batch_id bigint, input_rows bigint, rows_per_second double, trigger_ms bigint, add_batch_ms bigint, "
    "planning_ms bigint, state_rows bigint, state_removed bigint, watermark string"
)


def _progress_row(p) -> tuple:
    d = p.durationMs
    return (
        int(p.batchId), int(p.numInputRows), float(p.processedRowsPerSecond or 0.0), int(d.get("triggerExecution", 0)), int(d.get("addBatch", 0)),
        int(d.get("queryPlanning", 0)), sum(int(s.numRowsTotal) for s in p.stateOperators), sum(int(s.numRowsRemoved) for s in p.stateOperators), p.eventTime.get("watermark"),
    )


class ProgressLog(StreamingQueryListener):
    """Appends every progress row of the queries of one session, each under its run id.

    Spark itself keeps the last hundred batches of a query only. Rows are gathered and written in
    groups of ``group`` and at the end of a query, one file each, so a long query does not write a
    file for each batch; rows that were not written yet are lost with the driver alone.
    """

    def __init__(self, spark: SparkSession, path: str, group: int = 100):
        self.spark, self.path, self.group = spark, path, group
        self.rows: dict[str, list[tuple]] = {}
        self.lock = threading.Lock()
        self.written: set[str] = set()

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.rows.setdefault(str(event.runId), [])

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        with self.lock:
            self.rows.setdefault(run, []).append(_progress_row(event.progress))
            due = self._take(run) if len(self.rows[run]) >= self.group else []
        self._write(run, due)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        with self.lock:
            due = self._take(run)
        self._write(run, due)
        self.written.add(run)

    def _take(self, run: str) -> list[tuple]:
        due, self.rows[run] = self.rows.get(run, []), []
        return due

    def _write(self, run: str, due: list[tuple]) -> None:
        if due:
            self.spark.createDataFrame(due, PROGRESS).coalesce(1).write.mode("append").parquet(f"{self.path}/run={run}")

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Events arrive after a query has ended; this returns once its last rows are written."""
        end = time.monotonic() + seconds
        while str(query.runId) not in self.written:
            if time.monotonic() > end:
                raise TimeoutError(f"no end of query {query.runId} was reported")
            time.sleep(0.05)


@contextmanager
def logged_progress(spark: SparkSession, path: str, group: int = 100) -> Iterator[ProgressLog]:
    """Within the block every progress row of the session's queries is appended under ``path``."""
    log = ProgressLog(spark, path, group)
    spark.streams.addListener(log)
    try:
        yield log
    finally:
        spark.streams.removeListener(log)


def progress_table(spark: SparkSession, path: str, query: StreamingQuery) -> DataFrame:
    """Latency per micro-batch, all batches of one run of a query (a batch that was reported twice
    counts once, by its last report)."""
    rows = spark.read.schema(PROGRESS).parquet(f"{path}/run={query.runId}")
    names = [c for c in rows.columns if c != "batch_id"]
    return rows.groupBy("batch_id").agg(F.max_by(F.struct(*names), "trigger_ms").alias("p")).select("batch_id", "p.*")


def admission_latency(df: DataFrame, name: str = "admission", arrived: str = "arrived") -> DataFrame:
    """``df`` with observed metrics: rows, and the mean and largest time from arrival to decision in
    milliseconds, reported with the progress of each batch (see ``latency_table``)."""
    wait = (F.unix_micros(F.current_timestamp()) - F.unix_micros(F.col(arrived))) / 1000.0
    return df.observe(name, F.count(F.lit(1)).alias("n_rows"), F.avg(wait).alias("mean_ms"), F.max(wait).alias("max_ms"))


class LatencyLog(ProgressLog):
    """The observed admission latency of every batch, in the same way."""

    def __init__(self, spark: SparkSession, path: str, name: str = "admission", group: int = 100):
        super().__init__(spark, path, group)
        self.name = name

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is None:
            return
        run = str(event.progress.runId)
        with self.lock:
            self.rows.setdefault(run, []).append((int(event.progress.batchId), int(seen["n_rows"]), seen["mean_ms"], seen["max_ms"]))
            due = self._take(run) if len(self.rows[run]) >= self.group else []
        self._write(run, due)

    def _write(self, run: str, due: list[tuple]) -> None:
        if due:
            self.spark.createDataFrame(due, LATENCY).coalesce(1).write.mode("append").parquet(f"{self.path}/run={run}")


LATENCY = "batch_id bigint, n_rows bigint, mean_ms double, max_ms double"


def latency_table(spark: SparkSession, path: str, query: StreamingQuery) -> DataFrame:
    rows = spark.read.schema(LATENCY).parquet(f"{path}/run={query.runId}")
    return rows.groupBy("batch_id").agg(F.max_by(F.struct("n_rows", "mean_ms", "max_ms"), "n_rows").alias("p")).select("batch_id", "p.*")
