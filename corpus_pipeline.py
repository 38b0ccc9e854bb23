"""From raw documents to packed token sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the
last return the columns of ``docs``; the last returns packed pieces with their token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.functions.scratch import scratch_path
from siltmark.llm import lines, minhash, packing, quality, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_body"))
    led = quality.with_bits(quality.measure(rows, "_body", ["_row"]))
    return led.where(quality.passes()).select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs, from one line on, go; so do documents of which every line was one."""
    clean = lines.dedup(docs, min_words=1).where((F.col("n_lines") == 0) | (F.col("n_deleted") < F.col("n_lines")))
    return _recounted(clean, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays (rows that share an id stay together)."""
    kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept_id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a marker; every document stays."""
    return _recounted(secrets.redact(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and ids of every piece.

    Token ids do not travel through the packer: pieces are written once with a number each, and
    their places are joined back to that table by number (ids of documents may repeat).
    """
    found = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    path = scratch_path(spark, "pieces")
    found.withColumn("_piece", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    found = spark.read.parquet(path)
    narrow = found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("_piece").alias("number"))
    placed = packing.pack(narrow, docs.count(), ["doc_id", "piece", "length", "ids_crc32"], last=["number"])
    return placed.join(found.select("_piece", "ids"), F.col("number") == F.col("_piece")).drop("number", "_piece")


def _recounted(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with ``n_chars`` following the new text."""
    if "n_chars" in like.columns:
        kind = like.schema["n_chars"].dataType
        df = df.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(kind))
    return df.select(*like.columns)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("secret scan", secret_scan),
    ("packing", pack),
]

#: Tokenizing and match positions are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
