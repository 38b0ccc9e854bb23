import pytest
from pyspark.sql import functions as F

from siltmark.functions import scratch
from siltmark.functions.sizing import bounded_rows, known_classes, small_side


class _Session:
    """A session that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master})


def test_scratch_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert scratch.scratch_path(spark, "x").startswith(named.rstrip("/"))
    assert scratch.scratch_path(spark, "x") != scratch.scratch_path(spark, "x")


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError):
        scratch.scratch_root(_Session("spark://host:7077"))
    assert scratch.scratch_root(_Session("local[2]")) == scratch.scratch_root(_Session("local[2]"))


def test_only_measured_tables_are_broadcast(spark):
    df = spark.range(11).withColumn("x", F.col("id") * 2)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan(small_side(df, 11)) and "LocalRelation" not in plan(small_side(df, 10))
    assert sorted(small_side(df, 11).collect()) == sorted(small_side(df, 10).collect())


def test_contract_bounds_fail_loudly(spark):
    with pytest.raises(ValueError, match="more than 3"):
        bounded_rows(spark.range(4), 3, "rows")
    with pytest.raises(ValueError):
        known_classes(spark.range(20).withColumnRenamed("id", "label"), limit=10)
    assert known_classes(spark.createDataFrame([(2,), (None,), (1,)], "label int")) == [1, 2]
