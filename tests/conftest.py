import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .appName("siltmark-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-")


@pytest.fixture(scope="session")
def skewed(spark):
    """1,000 rows in five classes, 80 % of them in class 0; classes are well separated."""
    from pyspark.sql import functions as F

    h = F.md5(F.concat(F.lit("skew:"), F.col("id").cast("string")))
    noise = lambda i: (F.conv(F.substring(h, 1 + 2 * i, 2), 16, 10).cast("double") / 255.0 - 0.5) * 0.4
    label = F.when(F.col("id") % 10 < 8, 0).otherwise(F.pmod(F.floor(F.col("id") / 10), F.lit(4)) + 1).cast("int")
    df = spark.range(1000).withColumn("label", label)
    feats = F.array(*[(F.when(F.col("label") == i, 4.0).otherwise(0.0) + noise(i)).cast("float") for i in range(6)])
    df = df.select(
        F.col("id").alias("row_id"),
        feats.alias("features"),
        "label",
        (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)).alias("ts"),
        F.col("id").cast("double").alias("value"),
    )
    return df.cache()
