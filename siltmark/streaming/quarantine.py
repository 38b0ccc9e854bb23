"""Rows held back by a stream: a sink that may repeat a batch, and its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltmark.functions.sizing import small_side
from siltmark.operators.novelty import quarantine

COMMIT = "n_rows bigint, batch bigint"


def hold_batch(batch: DataFrame, batch_id: int, path: str, task: int) -> None:
    """Write the quarantined rows of a batch and then its commit record. Both carry the batch id
    and overwrite what an earlier try of the same batch left behind, so a repeat changes nothing;
    rows of a batch that never got its record are not read."""
    spark = batch.sparkSession
    rows = f"{path}/rows/batch={batch_id}"
    held = quarantine(batch, task)
    held.write.mode("overwrite").parquet(rows)
    n = spark.read.schema(held.schema).parquet(rows).count()
    spark.createDataFrame([(n, batch_id)], COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{batch_id}")


def quarantine_stream(df: DataFrame, path: str, task: int = 0) -> StreamingQuery:
    """Drain a stream of decided rows; the quarantined ones go to the table under ``path``."""
    return (
        df.writeStream.foreachBatch(lambda batch, batch_id: hold_batch(batch, batch_id, path, task))
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMIT).option("recursiveFileLookup", True).parquet(f"{path}/commits")


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Held rows of committed batches, as ``release`` takes them; a batch whose rows and record
    disagree is an error."""
    commits = small_side(read_commits(spark, path).select(F.col("batch").alias("_batch"), F.col("n_rows").alias("_n")))
    rows = spark.read.parquet(f"{path}/rows")
    held = rows.join(commits, F.col("batch") == F.col("_batch"), "left_semi")
    counts = held.groupBy("batch").agg(F.count("*").alias("n"))
    lost = commits.join(counts, F.col("_batch") == F.col("batch"), "left").where(F.coalesce("n", F.lit(0)) != F.col("_n"))
    if bad := lost.limit(10).collect():
        raise ValueError(f"batches {[r['_batch'] for r in bad]} do not hold the rows they committed")
    return held
