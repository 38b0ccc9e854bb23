import pytest
from pyspark.sql import functions as F

from siltmark.operators.corruption import conditions
from siltmark.sources.grid import experiment_grid
from siltmark.sources.tables import (
    MANIFEST_FIELDS, append_quarantine, content_checksum, dataset_card, file_checksums, manifest, read_layer, summary_table,
    write_conditions, write_layer, write_manifest,
)


def test_processed_layer_is_pruned_by_split_and_task(spark, skewed, folder):
    rows = skewed.select("row_id", "label", F.lit("train").alias("split"), (F.col("label") % 2).alias("task_id"))
    write_layer(rows, folder, "processed", "flows")
    back = read_layer(spark, folder, "processed", "flows")
    assert back.count() == 1000
    plan = back.where("split = 'train' and task_id = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan
    with pytest.raises(ValueError):
        write_layer(rows, folder, "other", "flows")


def test_card_and_checksums(spark, skewed, folder):
    rows = skewed.select("row_id", "label")
    card = dataset_card(rows, "flows", "generated", "none", "2024-01-01", "v1").head()
    assert card["n_rows"] == 1000 and card["n_classes"] == 5 and card["label_counts"]["0"] == 800
    assert content_checksum(rows.repartition(9)).head() == content_checksum(rows).head()
    changed = rows.withColumn("label", F.when(F.col("row_id") == 5, 1).otherwise(F.col("label")))
    assert content_checksum(changed).head()["checksum"] != card["checksum"]
    rows.coalesce(2).write.parquet(folder + "/p")
    sums = file_checksums(spark, folder + "/p", "*.parquet").collect()
    assert sums and all(len(r["sha256"]) == 64 for r in sums)


def test_conditions_are_written_apart(spark, skewed, folder):
    write_conditions(conditions(skewed.select("row_id", "label"), ["0", "0.1"], 1), folder + "/c")
    assert spark.read.parquet(folder + "/c/condition=clean").where("is_poisoned").count() == 0
    assert spark.read.parquet(folder + "/c/condition=flip_0.1").where("is_poisoned").count() == 100


def test_manifest_needs_every_field_and_summary_carries_it(spark, folder):
    run = {f: f for f in MANIFEST_FIELDS}
    write_manifest(spark, run, folder + "/m")
    metrics = spark.createDataFrame([("a", 1.0)], "metric string, value double")
    out = summary_table(metrics, spark.read.json(folder + "/m"), folder + "/s").head()
    assert out["commit"] == "commit" and out["metric"] == "a" and out["run_at"]
    assert spark.read.option("header", True).csv(folder + "/s").count() == 1
    run.pop("seeds")
    with pytest.raises(ValueError, match="seeds"):
        manifest(spark, run)


def test_quarantine_appends(spark, folder):
    part = spark.createDataFrame([(1,)], "row_id bigint")
    for _ in range(2):
        append_quarantine(part, folder + "/q")
    assert spark.read.parquet(folder + "/q").count() == 2


def test_grid_is_the_product(spark):
    g = experiment_grid(spark, [1, 2], ["0", "0.05"], [0.5], caps=(10, 50))
    assert g.count() == 16 and g.select("run_id").distinct().count() == 16
    assert {str(r[0]) for r in g.select("poison_rate").distinct().collect()} == {"0.000000", "0.050000"}


def test_files_with_another_header_order_are_refused(spark, folder):
    from pyspark.sql import types as T

    from siltmark.sources.flows import read_flows

    path = folder + "/headers"
    spark.createDataFrame([(1, 2.5)], "id int, v double").write.option("header", True).csv(path)
    kind = T._parse_datatype_string("v double, id int")
    assert [tuple(r) for r in read_flows(spark, path, kind)[0].collect()] == [(2.5, 1)]
    spark.createDataFrame([(7.5, 3)], "v double, id int").write.mode("append").option("header", True).csv(path)
    with pytest.raises(Exception, match="CSV header"):
        read_flows(spark, path, kind)[0].collect()


def test_large_files_are_hashed_in_stretches(spark, folder):
    """The digest of a file, whatever lies at its borders, with no task that reads more than a stretch."""
    import hashlib
    import os

    from siltmark.sources import tables

    held = {
        "plain.bin": bytes(range(256)) * 3000, "ended.bin": b"a\r\nb\n" * 90_000, "open.bin": b"x" * 70_000 + b"\n" + b"y" * 70_000,
        "mark.bin": b"\xef\xbb\xbf" + b"z\n" * 90_000, "mark_open.bin": b"\xef\xbb\xbf" + b"z\n" * 90_000 + b"z", "ends.bin": b"\n" * 150_000, "small.bin": b"s",
        "random.bin": os.urandom(1_000_000), "packed.gz": os.urandom(200_000),
    }
    for name, content in held.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = {r["file"]: (r["bytes"], r["sha256"]) for r in tables.file_checksums(spark, folder, whole=100_000).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in held.items()}


def test_layers_hold_hex_ids_in_half_their_digits(spark, folder):
    import os

    from siltmark.sources.tables import read_layer, write_layer

    rows = spark.range(0, 50_000, 1, 2).select(F.md5(F.col("id").cast("string")).alias("row_id"), (F.col("id") % 7).cast("int").alias("label"))
    path = write_layer(rows, folder, "interim", "ids")
    size = sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet"))
    assert size < 22 * 50_000  # 32 digits an id hold 16 bytes
    assert read_layer(spark, folder, "interim", "ids").exceptAll(rows).isEmpty()
