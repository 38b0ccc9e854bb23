"""Queries over arriving candidates, and the one-call experiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltmark.functions.scratch import scratch_path
from siltmark.operators.split import split
from siltmark.plans.experiment import Params, run
from siltmark.plans.inputs import SEED, SQL_EVENTS, TAU, TWO_TASKS, sql_lowest, table, vectors
from siltmark.plans.queries_metrics import EXPERIMENT_THRESHOLD, RATES, SQL_ADMIT, SQL_EXPERIMENT, SQL_NOVEL, THRESHOLD, admission_parts, known_model
from siltmark.plans.registry import query, rounded
from siltmark.streaming.candidates import dedup_stream, read_candidates, run_to_table, score_stream
from siltmark.operators.novelty import quarantine_marks
from siltmark.streaming.monitor import LatencyLog, admission_latency, latency_table, logged_progress, monitor, progress_table
from siltmark.streaming.quarantine import hold_batch, quarantine_stream, read_quarantine
from siltmark.streaming.replay import latest, replay_stream
from siltmark.streaming.statistics import (
    complete_table, expiring_state, expiring_sums, last_version, latest_values, prototype_stream, rocksdb_state, silent_sums,
)


def stream(spark, d, name):
    """A given table as a file stream. The trailing glob accepts a file or a folder."""
    schema = table(spark, d, name).schema
    return read_candidates(spark, f"{d}/{name}.parquet*", schema)


def file_per_batch(spark, d, name, key, files=4):
    """The given table as that many files by ascending key, one file in each micro-batch."""
    whole = table(spark, d, name)
    path = scratch_path(spark, name) + "/files"
    whole.repartitionByRange(files, key).write.parquet(path)
    return read_candidates(spark, path, whole.schema, 1)


def event_batches(spark, d):
    rows = file_per_batch(spark, d, "events", "event_id")
    return rows.select(F.col("event_id").alias("row_id"), F.col("event_type").alias("label"), "value", "ts")


def event_stream(spark, d):
    return stream(spark, d, "events").select(F.col("event_id").alias("row_id"), F.col("event_type").alias("label"), "value", "ts")


@query("q_stream_score", f"WITH {SQL_NOVEL} SELECT row_id, final_pred, round(max_prob, 6) AS max_prob FROM judged")
def q_stream_score(spark, d):
    model = known_model(spark, d)
    rows = stream(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("features"), "label")
    rows = split(rows, SEED).where(F.col("split") == "test")
    scored = score_stream(rows, model, THRESHOLD).select("row_id", "final_pred", "max_prob")
    out, _ = run_to_table(scored, "scored")
    return rounded(out, "max_prob")


@query("q_stream_replay", f"WITH {SQL_EVENTS} SELECT row_id, label FROM {sql_lowest('ev', '50', 'replay')}")
def q_stream_replay(spark, d):
    path = scratch_path(spark, "replay")
    replay_stream(event_batches(spark, d).select("row_id", "label"), path, 50, SEED).awaitTermination()
    return latest(spark, path).select("row_id", "label")


@query(
    "q_stream_counts",
    "SELECT event_type AS label, count(*) AS n_rows, round(sum(value), 6) AS total, round(sum(value * value), 6) AS squares FROM events GROUP BY event_type",
)
def q_stream_counts(spark, d):
    path = scratch_path(spark, "counts")
    complete_table(prototype_stream(event_batches(spark, d)), path).awaitTermination()
    return rounded(last_version(spark, path), "total", "squares")


@query(
    "q_stream_expiring",
    "SELECT event_type AS label, count(*) AS n_rows, round(sum(value), 6) AS total, round(sum(value * value), 6) AS squares FROM events GROUP BY event_type",
)
def q_stream_expiring(spark, d):
    """The same sums kept in salted state with a time to live of a day."""
    path = scratch_path(spark, "expiring")
    with expiring_state(spark):
        sums = expiring_sums(event_stream(spark, d), ttl_ms=86_400_000)
        complete_table(sums, path, "update").awaitTermination()
    parts = latest_values(spark, path, ["label", "salt"], ["n_rows", "total", "squares"])
    return rounded(parts.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("n_rows", "total", "squares")]), "total", "squares")


def _sql_windows(width: str, starts: str) -> str:
    return (
        f"SELECT {starts} AS window_start, {starts} + INTERVAL {width} AS window_end, count(*) AS n_rows, count(*) FILTER (WHERE event_type = 'error') AS n_flagged, "
        "round(count(*) FILTER (WHERE event_type = 'error')::DOUBLE / count(*), 6) AS rate FROM events GROUP BY 1, 2"
    )


def in_order(spark, d, arrival, files):
    """Rows of ``arrival`` (events with ``_arrival``) as a stream of that many files, written one after
    the other by equal steps of arrival: the source takes files by the time they were written."""
    start, end = arrival.agg(F.min("_arrival"), F.max("_arrival")).head()
    step = max(1, -(-(end - start + 1) // files))
    # All rows are dealt to their files in one scan by all tasks; a file is then put together from its share alone.
    root = scratch_path(spark, "in-order")
    path, dealt = f"{root}/files", f"{root}/dealt"
    rows = arrival.withColumn("_file", F.floor((F.col("_arrival") - start) / step).cast("int")).drop("_arrival")
    rows.write.partitionBy("_file").parquet(dealt)
    for k in range(files):
        part = spark.read.schema(rows.schema).parquet(dealt).where(F.col("_file") == k).drop("_file")
        part.coalesce(1).write.mode("append").parquet(path)
    return read_candidates(spark, path, arrival.drop("_arrival").schema, 1)


def seconds(ts="ts"):
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def late_batches(spark, d, files=4):
    """Events in that many micro-batches by arrival: each row comes up to twelve hours late."""
    late = F.pmod(F.xxhash64("event_id"), F.lit(12 * 3600))
    rows = in_order(spark, d, table(spark, d, "events").withColumn("_arrival", seconds() + late), files)
    return rows.select(F.col("event_id").alias("row_id"), F.col("event_type").alias("label"), "value", "ts")


def windows(spark, d, slide):
    """Windows kept in update mode: the watermark frees those that are over."""
    path = scratch_path(spark, "windows")
    counts = monitor(late_batches(spark, d), "6 hours", F.col("label") == "error", "1 day", slide)
    complete_table(counts, path, "update").awaitTermination()
    out = rounded(latest_values(spark, path, ["window_start", "window_end"], ["n_rows", "n_flagged", "rate"]), "rate")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("q_stream_windows", _sql_windows("6 HOURS", "time_bucket(INTERVAL 6 HOURS, ts)"))
def q_stream_windows(spark, d):
    return windows(spark, d, None)


@query(
    "q_stream_sliding",
    """WITH w AS (SELECT time_bucket(INTERVAL 3 HOURS, ts) - INTERVAL 3 HOURS * k AS s, event_type FROM events, (SELECT unnest([0, 1]) AS k))
    SELECT s AS window_start, s + INTERVAL 6 HOURS AS window_end, count(*) AS n_rows, count(*) FILTER (WHERE event_type = 'error') AS n_flagged,
    round(count(*) FILTER (WHERE event_type = 'error')::DOUBLE / count(*), 6) AS rate FROM w GROUP BY s""",
)
def q_stream_sliding(spark, d):
    return windows(spark, d, "3 hours")


@query("q_stream_window_state", "SELECT 4 AS n_batches, count(*) AS input_rows, true AS state_fell, true AS state_is_part FROM events")
def q_stream_window_state(spark, d):
    """What the windows cost: their state, by the progress log, is freed while the stream runs and
    never holds more than two thirds of the windows of the whole month."""
    path = scratch_path(spark, "window-state")
    counts = monitor(late_batches(spark, d), "6 hours", F.col("label") == "error", "1 day")
    with logged_progress(spark, path + "/progress") as log:
        q = complete_table(counts, path, "update")
        q.awaitTermination()
        log.wait(q)
    seen = latest_values(spark, path, ["window_start"], ["n_rows"]).count()
    p = progress_table(spark, path + "/progress", q)
    return p.agg(
        F.count_if(F.col("input_rows") > 0).cast("int").alias("n_batches"), F.sum("input_rows").alias("input_rows"), (F.sum("state_removed") > 0).alias("state_fell"),
        (3 * F.max("state_rows") < 2 * F.lit(seen)).alias("state_is_part"),
    )


@query("q_stream_dedup", "SELECT event_id AS row_id, event_type AS label, ts FROM events")
def q_stream_dedup(spark, d):
    """Every row arrives twice, the second time in a later micro-batch, and counts once."""
    rows = table(spark, d, "events")
    start, end = rows.agg(F.min(seconds()), F.max(seconds())).head()
    step = max(1, (end - start) // 6)  # copies come this much later; a batch is shorter
    twice = rows.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_arrival", seconds() + F.col("_copy") * step).drop("_copy")
    arriving = in_order(spark, d, twice, 8).select(F.col("event_id").alias("row_id"), F.col("event_type").alias("label"), "ts")
    out, _ = run_to_table(dedup_stream(arriving, f"{2 * step} seconds"), "dedup")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


SILENCE = 5 * 86_400_000


@query(
    "q_stream_silence",
    """WITH e AS (SELECT * FROM events WHERE NOT (event_type = 'error' AND ts > (SELECT min(ts) + INTERVAL 10 DAY FROM events)))
    SELECT event_type AS label, count(*) AS n_rows, round(sum(value), 6) AS total, round(sum(value * value), 6) AS squares FROM e
    GROUP BY event_type HAVING max(ts) + INTERVAL 5 DAY > (SELECT max(ts) - INTERVAL 1 HOUR FROM e)""",
)
def q_stream_silence(spark, d):
    """A class that says nothing after the tenth day leaves the running sums."""
    rows = table(spark, d, "events")
    start = rows.agg(F.min("ts").cast("string")).head()[0]
    rows = rows.where((F.col("event_type") != "error") | (F.col("ts") <= F.lit(start).cast(rows.schema["ts"].dataType) + F.expr("interval 10 day")))
    rows = in_order(spark, d, rows.withColumn("_arrival", seconds()), 4).select(F.col("event_id").alias("row_id"), F.col("event_type").alias("label"), "value", "ts")
    path = scratch_path(spark, "silence")
    with rocksdb_state(spark):
        complete_table(silent_sums(rows, SILENCE, "1 hour", salts=4), path, "update").awaitTermination()
    parts = latest_values(spark, path, ["label", "salt"], ["n_rows", "total", "squares"], "closed")
    return rounded(parts.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("n_rows", "total", "squares")]), "total", "squares")


@query("q_stream_admission", f"WITH {SQL_ADMIT} SELECT row_id, claimed, decision, reason FROM dec")
def q_stream_admission(spark, d):
    """Candidates written as files, then judged as they stream in."""
    cand, defence = admission_parts(spark, d)
    path = scratch_path(spark, "candidates") + "/in"
    cand.write.parquet(path)
    rows = read_candidates(spark, path, cand.schema)
    scored = score_stream(rows, defence.model, THRESHOLD, defence)
    out, _ = run_to_table(scored.select("row_id", F.col("label").alias("claimed"), "decision", "reason"), "decisions")
    return out


def admission_stream(spark, d, files):
    """Decisions over candidates that arrive in that many files, with the time each file arrived."""
    cand, defence = admission_parts(spark, d)
    path = scratch_path(spark, "candidates") + "/in"
    cand.repartitionByRange(files, "row_id").write.parquet(path)
    rows = read_candidates(spark, path, cand.schema, 1).withColumn("arrived", F.col("_metadata.file_modification_time"))
    return score_stream(rows, defence.model, THRESHOLD, defence)


@query("q_stream_quarantine", f"WITH {SQL_ADMIT} SELECT row_id, claimed, reason, 2 AS arrived_task FROM dec WHERE decision = 'quarantine'")
def q_stream_quarantine(spark, d):
    """Held rows of four batches; one batch is repeated and one broke off before its record."""
    path = scratch_path(spark, "held")
    decided = admission_stream(spark, d, 4).select("row_id", F.col("label").alias("claimed"), "decision", "reason")
    quarantine_stream(decided, path, 2).awaitTermination()
    aside = scratch_path(spark, "first-batch")
    spark.read.parquet(f"{path}/rows/batch=0").drop("arrived_task", "released_task").write.parquet(aside)
    first = spark.read.parquet(aside)
    hold_batch(first, 0, path, 2)
    first.withColumns(quarantine_marks(2)).write.parquet(f"{path}/rows/batch=99")
    return read_quarantine(spark, path).select("row_id", "claimed", "reason", "arrived_task")


@query("q_stream_decision_latency", f"WITH {SQL_ADMIT} SELECT 4 AS n_batches, count(*) AS n_rows, true AS measured FROM dec")
def q_stream_decision_latency(spark, d):
    """Time from the arrival of a candidate's file to its decision, batch by batch."""
    path = scratch_path(spark, "decision-latency")
    decided = admission_latency(admission_stream(spark, d, 4)).select("row_id", "decision")
    log = LatencyLog(spark, path + "/log")
    spark.streams.addListener(log)
    try:
        _, q = run_to_table(decided, "decisions")
        log.wait(q)
    finally:
        spark.streams.removeListener(log)
    found = latency_table(spark, path + "/log", q).where("n_rows > 0")
    sound = (F.col("mean_ms") > 0) & (F.col("mean_ms") <= F.col("max_ms") + 1e-6)
    return found.agg(F.count("*").cast("int").alias("n_batches"), F.sum("n_rows").alias("n_rows"), F.bool_and(sound).alias("measured"))


MANY = 120


@query("q_stream_latency", f"SELECT n AS input_rows, count(*) AS n_batches, true AS measured FROM (SELECT count(*) AS n FROM events GROUP BY event_id % {MANY}) GROUP BY n")
def q_stream_latency(spark, d):
    """Progress of every one of more micro-batches than Spark itself remembers."""
    rows = table(spark, d, "events")
    path = scratch_path(spark, "latency")
    parts = rows.select("event_id", "event_type", "value", (F.col("event_id") % MANY).cast("int").alias("part"))
    parts.repartition("part").write.partitionBy("part").parquet(path + "/in")
    arriving = read_candidates(spark, path + "/in", parts.schema, 1).select("event_id", "value")
    with logged_progress(spark, path + "/progress") as log:
        _, q = run_to_table(arriving, "seen")
        log.wait(q)
    p = progress_table(spark, path + "/progress", q).where("input_rows > 0")
    return p.groupBy("input_rows").agg(F.count("*").alias("n_batches"), F.bool_and((F.col("trigger_ms") >= F.col("add_batch_ms")) & (F.col("trigger_ms") > 0)).alias("measured"))


@query("q_run_metrics", f"WITH {SQL_EXPERIMENT} SELECT rate, metric, round(value, 6) AS value FROM metrics")
def q_run_metrics(spark, d):
    """The whole experiment in one call, with every table and the manifest written."""
    p = Params("clean against flipped labels", "embeddings", SEED, TWO_TASKS, RATES, EXPERIMENT_THRESHOLD, TAU, output=scratch_path(spark, "run"))
    return rounded(run(vectors(spark, d), p)["metrics"], "value")
