"""Replay buffer over a stream: one Parquet version per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltmark.operators.tasks import REPLAY_CAP, merge_buffer, one_per_id, replay_buffer


def version_path(path: str, version: int) -> str:
    return f"{path}/buffer/buffer_version={version}"


def replay_stream(
    df: DataFrame, path: str, cap: int = REPLAY_CAP, seed: int = 0, row_id: str = "row_id", label: str = "label"
) -> StreamingQuery:
    """Start the query; version n + 1 is the merge of version n and batch n.

    ``foreachBatch`` may repeat a batch after a failure. A batch reads only the version its
    id names and overwrites only the one after it, so a repeat writes the same rows again.
    """
    schema = df.schema

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = one_per_id(batch, row_id, [label]).persist()  # read by each selection pass
        if batch_id == 0:
            merged = replay_buffer(fresh, cap, seed, row_id, label)
        else:
            old = spark.read.schema(schema).parquet(version_path(path, batch_id))
            merged = merge_buffer(old, fresh, cap, seed, row_id, label)
        # Only the selected rows, at most cap per class, meet in the one file of a version.
        merged.repartition(1).write.mode("overwrite").parquet(version_path(path, batch_id + 1))
        fresh.unpersist()

    return (
        df.writeStream.foreachBatch(merge)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """All versions with their ``buffer_version``; old ones stay for persistence studies."""
    return spark.read.parquet(f"{path}/buffer")


def latest(spark: SparkSession, path: str) -> DataFrame:
    versions = read_versions(spark, path)
    last = versions.agg(F.max("buffer_version")).head()[0]
    return versions.where(F.col("buffer_version") == last)
