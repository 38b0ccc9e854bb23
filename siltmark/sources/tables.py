"""Layered tables, per-condition outputs, dataset cards, run manifests and summaries."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.functions import digest
from siltmark.functions.scratch import scratch_path
from siltmark.functions.sizing import MAX_CLASSES, bounded_rows

# The folders a data set is laid out in.
LAYERS = ("raw", "interim", "processed", "metadata")

# The fields every run manifest records.
MANIFEST_FIELDS = (
    "experiment",
    "commit",
    "dataset",
    "split",
    "class_map",
    "seeds",
    "model",
    "hyperparameters",
    "poisoning",
    "novelty",
    "metrics_location",
    "limitations",
)

#: A file of at most so many bytes is hashed as a whole by one task.
WHOLE_BYTES = 256 << 20
PACKED = r"\.(gz|gzip|bz2|deflate|lz4|snappy|zst|zstd)$"
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def layer_path(root: str, layer: str, name: str) -> str:
    if layer not in LAYERS:
        raise ValueError(f"layer must be one of {LAYERS}")
    return f"{root.rstrip('/')}/{layer}/{name}"


def write_layer(df: DataFrame, root: str, layer: str, name: str, mode: str = "errorifexists") -> str:
    """Write one table of a layer; processed tables are partitioned for pruning by split and
    task. Rows are not repartitioned first: a hot (split, task) stays spread over its tasks. Row ids
    of hex digits are most of a row, and zstd keeps them in half the bytes."""
    path = layer_path(root, layer, name)
    keys = [c for c in ("split", "task_id") if c in df.columns] if layer == "processed" else []
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)
    return path


def read_layer(spark: SparkSession, root: str, layer: str, name: str) -> DataFrame:
    return spark.read.parquet(layer_path(root, layer, name))


def write_conditions(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Clean and corrupted rows in separate folders, one per condition."""
    df.write.mode(mode).partitionBy("condition").parquet(path)
    return path


def append_quarantine(held: DataFrame, path: str) -> str:
    held.write.mode("append").parquet(path)
    return path


def file_checksums(spark: SparkSession, path: str, glob: str = "*", whole: int = WHOLE_BYTES) -> DataFrame:
    """``file, bytes, sha256`` of every file under a path, hashed where it is read. Files above
    ``whole`` bytes are read by many tasks and hashed a stretch of that size at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    hashed = lambda df: df.select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    # The source skips the content of files that a plain comparison of lengths leaves out.
    out = hashed(files.where(F.col("length") <= whole))
    found = files.where(F.col("length") > whole).select("path", name, "length").collect()
    # A reader of lines would unpack packed files.
    large = [r for r in found if digest.library() and not re.search(PACKED, r["path"].lower())]
    if others := [r["path"] for r in found if r not in large]:
        out = out.unionByName(hashed(spark.read.format("binaryFile").load(others)))
    if not large:
        return out
    rows = [(r["file"], r["length"], _long_digest(spark, r["path"], r["length"], whole)) for r in large]
    return out.unionByName(spark.createDataFrame(rows, "file string, bytes bigint, sha256 string"))


def _long_digest(spark: SparkSession, path: str, length: int, whole: int) -> str:
    """SHA-256 of one large file: its blocks are read and written as pieces by many tasks; then a
    task after the other takes the next stretch and hands on 112 bytes of state."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("line"))
    pieces = lines.mapInArrow(digest.join_lines, "at bigint, n bigint, size bigint, bytes binary")
    folder = scratch_path(spark, "file-pieces")
    pieces.withColumn("stretch", F.floor(F.col("at") / whole).cast("int")).write.partitionBy("stretch").parquet(folder)
    pieces = spark.read.parquet(folder)
    total = pieces.agg(F.sum("size")).head()[0]
    # The reader of lines drops a byte order mark at the start and adds an end to the last line.
    mark = BYTE_ORDER_MARK if total <= length - 2 else b""
    missing = length - total - len(mark)
    if missing not in (0, -1):
        raise ValueError(f"{path}: {total} bytes were read of {length}")
    state, first = digest.proceed(digest.begin(), [mark]), True
    for (stretch,) in pieces.select("stretch").distinct().orderBy("stretch").collect():
        part = pieces.where(F.col("stretch") == stretch).coalesce(1).sortWithinPartitions("at", "n").select("bytes")
        state, first = bytes(part.mapInArrow(digest.step(state, first), "state binary").head()[0]), False
    return digest.finish(digest.proceed(state, [b"\n"] if missing == 0 else []))


def content_checksum(df: DataFrame) -> DataFrame:
    """One row: an order-independent checksum of the table, the sum of 60-bit row hashes.

    Unlike a file digest it needs no whole file in memory and does not change when the same
    rows are written in other files.
    """
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns]))
    bits = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(bits), F.lit(0)).cast("decimal(38,0)").alias("checksum"))


def dataset_card(
    df: DataFrame, name: str, source: str, licence: str = "", retrieved: str = "", preprocessing: str = "", label: str = "label"
) -> DataFrame:
    """One row: source, licence, schema, label map with counts, rows, classes, checksum and
    preprocessing version."""
    counts = df.groupBy(F.col(label).cast("string").alias("k")).agg(F.count("*").alias("v"))
    rows = sorted(bounded_rows(counts, MAX_CLASSES, "classes"), key=lambda r: (r["k"] is None, r["k"] or ""))
    pairs = [v for r in rows for v in (F.lit("NULL" if r["k"] is None else r["k"]), F.lit(r["v"]))]
    label_map = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,bigint>)")
    return content_checksum(df).select(
        F.lit(name).alias("dataset"),
        F.lit(source).alias("source"),
        F.lit(licence).alias("licence"),
        F.lit(retrieved).alias("retrieved"),
        F.lit(df.schema.simpleString()).alias("schema"),
        label_map.alias("label_counts"),
        F.lit(len(rows)).cast("bigint").alias("n_classes"),
        "n_rows",
        "checksum",
        F.lit(preprocessing).alias("preprocessing_version"),
    )


def manifest(spark: SparkSession, run: dict) -> DataFrame:
    """One row: every required field as a JSON value, and the time of the run."""
    import json

    missing = [f for f in MANIFEST_FIELDS if f not in run]
    if missing:
        raise ValueError(f"manifest lacks {', '.join(missing)}")
    cells = [F.lit(run[f] if isinstance(run[f], str) else json.dumps(run[f], sort_keys=True, default=str)).alias(f) for f in MANIFEST_FIELDS]
    return spark.range(1).select(*cells, F.lit(datetime.now(timezone.utc).isoformat()).alias("run_at"))


def write_manifest(spark: SparkSession, run: dict, path: str, mode: str = "errorifexists") -> DataFrame:
    table = manifest(spark, run)
    table.coalesce(1).write.mode(mode).json(path)
    return table


def summary_table(metrics: DataFrame, run: DataFrame, path: str | None = None) -> DataFrame:
    """Metric rows with the experiment, commit, seeds, settings and time that made them."""
    row = run.head()
    stamp = [F.lit(row[c]).alias(c) for c in ("experiment", "commit", "seeds", "hyperparameters", "run_at")]
    out = metrics.select(*stamp, *metrics.columns)
    if path:
        out.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)
    return out
