import pytest
from pyspark.sql import functions as F

from siltmark.operators.admission import Defence, Policy
from siltmark.operators.classifier import PrototypeClassifier
from siltmark.operators.tasks import replay_buffer
from siltmark.streaming.candidates import dedup_stream, read_candidates, run_to_table, score_stream
from siltmark.streaming.monitor import LatencyLog, admission_latency, latency_table, logged_progress, monitor, progress_table
from siltmark.streaming.quarantine import hold_batch, quarantine_stream, read_commits, read_quarantine
from siltmark.streaming.replay import latest, read_versions, replay_stream, version_path
from siltmark.streaming.statistics import (
    complete_table, expiring_state, expiring_sums, last_version, latest_values, prototype_stream, rocksdb_state, silent_sums,
)


@pytest.fixture()
def arriving(spark, skewed, folder):
    """Four files written one after the other; the last repeats the rows of the third."""
    path = folder + "/in"
    for i in (0, 1, 2, 2):
        skewed.where(F.floor(F.col("row_id") / 334) == i).coalesce(1).write.mode("append").parquet(path)
    return lambda n=1: read_candidates(spark, path, skewed.schema, n)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_scoring_equals_batch(skewed, arriving):
    model = PrototypeClassifier().fit(skewed.where("label < 4"))
    d = Defence.fit(model, skewed.where("label < 4"), Policy(0.5, 6.0, None, 1.0))
    cols = ("row_id", "final_pred", "decision")
    out, _ = run_to_table(score_stream(arriving().select("row_id", "features", "label"), model, 0.9, d).select(*cols), "t")
    want = score_stream(skewed.select("row_id", "features", "label"), model, 0.9, d)
    assert sorted(set(rows(out, *cols))) == rows(want, *cols)


def test_replay_versions_equal_the_batch_buffer(spark, skewed, arriving, folder):
    path = folder + "/replay"
    replay_stream(arriving().select("row_id", "label"), path, 20, 3).awaitTermination()
    assert rows(latest(spark, path), "row_id", "label") == rows(replay_buffer(skewed.select("row_id", "label"), 20, 3), "row_id", "label")
    versions = {r["buffer_version"] for r in read_versions(spark, path).select("buffer_version").distinct().collect()}
    assert versions == {1, 2, 3, 4}


def test_a_repeated_batch_rewrites_its_own_version(spark, skewed, arriving, folder):
    from siltmark.operators.tasks import merge_buffer

    path = folder + "/replay"
    replay_stream(arriving().select("row_id", "label"), path, 20, 3).awaitTermination()
    before = rows(spark.read.parquet(version_path(path, 2)), "row_id")
    old = spark.read.parquet(version_path(path, 1))
    batch = skewed.where(F.floor(F.col("row_id") / 334) == 1).select("row_id", "label")
    assert rows(merge_buffer(old, batch, 20, 3), "row_id") == before


def test_statistics_and_progress(spark, skewed, arriving, folder):
    with logged_progress(spark, folder + "/p", group=2) as log:
        q = complete_table(prototype_stream(arriving()), folder + "/s")
        q.awaitTermination()
        log.wait(q)
        other = complete_table(prototype_stream(arriving()), folder + "/s2")
        other.awaitTermination()
        log.wait(other)
    got = {r["label"]: (r["n_rows"], r["total"]) for r in last_version(spark, folder + "/s").collect()}
    both = skewed.union(skewed.where("row_id >= 668"))
    assert got == {r["label"]: (r["n"], r["t"]) for r in both.groupBy("label").agg(F.count("*").alias("n"), F.sum("value").alias("t")).collect()}
    p = progress_table(spark, folder + "/p", q).orderBy("batch_id").collect()
    assert [r["input_rows"] for r in p if r["input_rows"]] == [334, 334, 332, 332] and all(r["trigger_ms"] > 0 for r in p)
    assert sum(r["input_rows"] for r in progress_table(spark, folder + "/p", other).collect()) == both.count()


def test_time_from_arrival_to_decision_is_logged(spark, arriving, folder):
    rows = admission_latency(arriving().withColumn("arrived", F.current_timestamp() - F.expr("interval 1 hour"))).select("row_id")
    log = LatencyLog(spark, folder + "/l")
    spark.streams.addListener(log)
    try:
        _, q = run_to_table(rows, "d")
        log.wait(q)
    finally:
        spark.streams.removeListener(log)
    got = [tuple(r) for r in latency_table(spark, folder + "/l", q).where("n_rows > 0").orderBy("batch_id").select("n_rows", "mean_ms", "max_ms").collect()]
    assert [n for n, _, _ in got] == [334, 334, 332, 332]
    assert all(3_600_000 <= mean <= top + 1e-6 < 3_700_000 for _, mean, top in got)


@pytest.fixture()
def in_time(spark, folder):
    """Class 0 falls silent after 40 minutes; rows come in four files, the later ones with late rows."""

    def write(minutes, labels=(0, 1)):
        rows = [(m * 10 + k, k, float(m), m) for m in minutes for k in labels if k or m < 40]
        df = spark.createDataFrame(rows, "row_id bigint, label int, value double, m bigint")
        df = df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("m") * 60)).drop("m")
        df.coalesce(1).write.mode("append").parquet(folder + "/timed")
        return df

    parts = [write(m) for m in (range(0, 60), [*range(60, 120), 55, 58], [*range(120, 200), 115], [*range(200, 300), 199])]
    whole = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return whole, lambda: read_candidates(spark, folder + "/timed", whole.schema, 1)


def test_windows_free_their_state_and_equal_batch(spark, in_time, folder):
    whole, stream = in_time
    with logged_progress(spark, folder + "/p") as log:
        q = complete_table(monitor(stream(), "10 minutes", F.col("label") == 1, "10 minutes"), folder + "/w", "update")
        q.awaitTermination()
        log.wait(q)
    keys, values = ["window_start", "window_end"], ["n_rows", "n_flagged", "rate"]
    got = latest_values(spark, folder + "/w", keys, values)
    want = monitor(whole, "10 minutes", F.col("label") == 1, "10 minutes")
    assert rows(got, *keys, *values) == rows(want, *keys, *values)
    p = progress_table(spark, folder + "/p", q)
    assert p.agg(F.max("state_rows")).head()[0] < got.count() and p.agg(F.sum("state_removed")).head()[0] > 0


def test_a_silent_class_leaves_with_a_tombstone(spark, in_time, folder):
    whole, stream = in_time
    with rocksdb_state(spark):
        complete_table(silent_sums(stream(), 60 * 60_000, "10 minutes", salts=2), folder + "/t", "update").awaitTermination()
    every = latest_values(spark, folder + "/t", ["label", "salt"], ["n_rows", "closed"]).collect()
    assert {r["label"] for r in every if r["closed"]} == {"0"} and {r["label"] for r in every if not r["closed"]} == {"1"}
    parts = latest_values(spark, folder + "/t", ["label", "salt"], ["n_rows", "total"], "closed")
    (left,) = parts.groupBy("label").agg(F.sum("n_rows").alias("n"), F.sum("total").alias("t")).collect()
    want = whole.where("label = 1").agg(F.count("*"), F.sum("value")).head()
    assert (left["label"], left["n"], left["t"]) == ("1", *want)


def test_quarantine_sink_repeats_and_recovers(spark, skewed, arriving, folder):
    path = folder + "/held"
    decided = arriving().withColumn("decision", F.when(F.col("label") == 2, "quarantine").otherwise("admit")).select("row_id", "label", "decision")
    quarantine_stream(decided, path, 4).awaitTermination()
    both = skewed.union(skewed.where("row_id >= 668"))
    want = rows(both.where("label = 2"), "row_id")
    assert rows(read_quarantine(spark, path), "row_id") == want
    first = skewed.where("row_id < 334").withColumn("decision", F.when(F.col("label") == 2, "quarantine").otherwise("admit")).select("row_id", "label", "decision")
    for _ in range(2):
        hold_batch(first, 0, path, 4)
    assert rows(read_quarantine(spark, path), "row_id") == want and read_commits(spark, path).count() == 4
    spark.read.parquet(path + "/rows/batch=1").write.parquet(path + "/rows/batch=77")  # broke off before its record
    assert rows(read_quarantine(spark, path), "row_id") == want
    spark.read.parquet(path + "/rows/batch=1").limit(1).write.mode("append").parquet(path + "/rows/batch=2")
    with pytest.raises(ValueError, match="committed"):
        read_quarantine(spark, path)


def test_windows_equal_batch(spark, skewed, arriving, folder):
    flag = F.col("label") == 0
    complete_table(monitor(arriving(2), "1 hour", flag, "1 day", "30 minutes"), folder + "/w").awaitTermination()
    both = skewed.union(skewed.where("row_id >= 668"))
    cols = ("window_start", "n_rows", "n_flagged", "rate")
    assert rows(last_version(spark, folder + "/w"), *cols) == rows(monitor(both, "1 hour", flag, "1 day", "30 minutes"), *cols)


def test_every_id_counts_once(skewed, arriving):
    out, _ = run_to_table(dedup_stream(arriving().select("row_id", "ts"), "7 days"), "d")
    assert rows(out, "row_id") == rows(skewed, "row_id")


@pytest.mark.parametrize("ttl_ms", [None, 3_600_000])
def test_expiring_state_keeps_the_same_sums(spark, skewed, arriving, folder, ttl_ms):
    with expiring_state(spark):
        q = complete_table(expiring_sums(arriving(), ttl_ms=ttl_ms, salts=3), folder + "/e", "update")
        ended = q.awaitTermination(90)
        q.stop()
    assert ended
    parts = latest_values(spark, folder + "/e", ["label", "salt"], ["n_rows", "total"])
    got = {r["label"]: (r["n"], r["t"]) for r in parts.groupBy("label").agg(F.sum("n_rows").alias("n"), F.sum("total").alias("t")).collect()}
    both = skewed.union(skewed.where("row_id >= 668"))
    assert got == {str(r["label"]): (r["n"], r["t"]) for r in both.groupBy("label").agg(F.count("*").alias("n"), F.sum("value").alias("t")).collect()}


def test_rows_in_order_are_read_once(spark, tmp_path):
    """A stream of many files scans its source for the range and for dealing, not once per file."""
    from siltmark.plans.queries_stream import in_order

    read = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def counted(v):
        read.add(1)
        return v

    counted = counted.asNondeterministic()
    rows = spark.range(64, numPartitions=4).select("id", counted("id").alias("_arrival"))
    out, query = run_to_table(in_order(spark, None, rows, 8), "in-order", str(tmp_path / "out"))
    assert sorted(r["id"] for r in out.collect()) == list(range(64))
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [8] * 8
    assert read.value == 2 * 64
