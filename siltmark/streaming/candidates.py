"""Arriving candidates: the stream source, scoring and exactly-once ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from siltmark.functions.scratch import scratch_path
from siltmark.operators.admission import Defence, admit
from siltmark.operators.classifier import PrototypeClassifier
from siltmark.operators.novelty import detect_unknown, label_unknown


def read_candidates(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """File stream under a declared schema; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", int(files_per_batch))
    return reader.parquet(path)


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; zone-less timestamps are read as UTC session time."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def score_stream(df: DataFrame, model: PrototypeClassifier, threshold: float, defence: Defence | None = None) -> DataFrame:
    """Stateless scoring of batch or stream rows: prediction, unknown mark and decision."""
    scored = admit(df, defence) if defence is not None else model.predict(df)
    return label_unknown(detect_unknown(scored, threshold))


def dedup_stream(df: DataFrame, delay: str, row_id: str = "row_id", ts: str = "ts") -> DataFrame:
    """A row id counts once, also when it arrives again within the watermark delay. State
    holds ids for that long only."""
    return event_time(df, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark([row_id])


def run_to_table(df: DataFrame, name: str, path: str | None = None) -> tuple[DataFrame, StreamingQuery]:
    """Drain a stream into a Parquet table (exactly once by the sink's log) and read it back."""
    spark = df.sparkSession
    out = path or scratch_path(spark, name)
    query = (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{out}/table")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/table"), query
