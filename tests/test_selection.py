import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siltmark.functions.hashing import seed_key
from siltmark.operators import selection
from siltmark.operators.selection import hash_rank, lowest_cuts, mark_lowest, select_lowest
from siltmark.operators.split import fraction, split, split_stratified, subset


def ids(df):
    return sorted(r[0] for r in df.select("row_id").collect())


def brute(df, k, salt, seed, group):
    w = Window.partitionBy(*group).orderBy(seed_key(salt, seed, "row_id"), "row_id")
    return df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)


@pytest.mark.parametrize("k", [0, 1, 7, 60, 799, 10_000])
def test_lowest_rows_match_a_full_sort(skewed, k):
    got = select_lowest(skewed, k, 3, "t", group=["label"])
    assert ids(got) == ids(brute(skewed, k, "t", 3, ["label"]))


def test_selection_ignores_partitioning(skewed):
    runs = [ids(select_lowest(skewed.repartition(n), 40, 3, "t", group=["label"])) for n in (1, 4, 50)]
    assert runs[0] == runs[1] == runs[2]


def test_null_groups_are_groups(spark, skewed):
    df = skewed.withColumn("label", F.when(F.col("label") != 1, F.col("label")))
    assert ids(select_lowest(df, 5, 3, "t", group=["label"])) == ids(brute(df, 5, "t", 3, ["label"]))


@pytest.mark.parametrize("range_rows", [1, 50, 1 << 16])
def test_bracket_that_misses_is_narrowed(skewed, range_rows, monkeypatch):
    """A slack of zero makes the bracket too narrow for most cuts; results stay exact."""
    monkeypatch.setattr(selection, "RANGE_ROWS", range_rows)
    cuts = lowest_cuts(skewed, {"k": lambda n: F.lit(31)}, 3, "t", group=["label"], slack=0.0)
    got = mark_lowest(skewed, cuts, ["k"], 3, "t", group=["label"]).where("in_k")
    assert ids(got) == ids(brute(skewed, 31, "t", 3, ["label"]))


@pytest.mark.parametrize("group", [["label"], []])
@pytest.mark.parametrize("k", [1, 150, 399, 640])
def test_repeated_ids_come_whole(spark, monkeypatch, group, k):
    """Ids of 1 to 300 rows, a third of all rows one id: all rows of the id of the k-th row come."""
    monkeypatch.setattr(selection, "RANGE_ROWS", 4)
    rows = [(i if i % 3 else 0, i % 2) for i in range(900)] + [(7, 0)] * 50
    df = spark.createDataFrame(rows, "row_id bigint, label int")
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy(seed_key("t", 3, "row_id"), "row_id")
    want = df.withColumn("r", F.rank().over(w)).where(F.col("r") <= k)
    got = select_lowest(df, k, 3, "t", group=group, ties="whole")
    assert sorted(map(tuple, got.select("row_id", "label").collect())) == sorted(map(tuple, want.select("row_id", "label").collect()))


def test_a_cut_inside_repeated_ids_is_an_error(spark):
    df = spark.createDataFrame([(1,)] * 500 + [(2,)] * 500, "row_id bigint")
    with pytest.raises(ValueError, match="repeat"):
        select_lowest(df, 30, 3, "t")


def test_narrowing_orders_a_bounded_share(spark, monkeypatch):
    """The range that is ordered after narrowing holds few rows, though the bracket missed."""
    monkeypatch.setattr(selection, "RANGE_ROWS", 32)
    df = spark.range(20_000).select(F.col("id").alias("row_id"))
    keyed = df.select(F.col("row_id").alias("_id"), seed_key("t", 3, "row_id").alias("_h"))
    cuts = spark.createDataFrame([("k", 7_000)], "quota string, k bigint")
    at = selection._narrowed(keyed, cuts, []).head()
    inside = keyed.where((F.col("_h") >= at["_lo"]) & (F.col("_h") < at["_hi"])).count()
    assert 0 < inside <= 32
    assert keyed.where(F.col("_h") < at["_lo"]).count() < 7_000 <= keyed.where(F.col("_h") < at["_hi"]).count()


def test_many_groups_shuffle_instead_of_broadcasting(skewed, monkeypatch):
    """Beyond the size bound the cuts stay a distributed table; the rows are the same."""
    import siltmark.functions.sizing as sizing

    monkeypatch.setattr(selection, "small_table", lambda df, limit=2: sizing.small_table(df, 2))
    monkeypatch.setattr(selection, "small_side", lambda df, limit=2: sizing.local_side(df, sizing.small_table(df, 2)))
    got = select_lowest(skewed, 9, 3, "t", group=["label"])
    assert ids(got) == ids(brute(skewed, 9, "t", 3, ["label"]))


def test_selecting_shuffles_no_rows(skewed):
    plan = select_lowest(skewed, 9, 3, "t", group=["label"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Sort" not in plan


@pytest.mark.parametrize("bucket_rows", [20, 1_000_000])
def test_hash_rank_is_gapless_and_equal_to_a_window(skewed, bucket_rows):
    w = Window.partitionBy("label").orderBy(seed_key("t", 3, "row_id"), "row_id")
    want = skewed.select("row_id", F.row_number().over(w).cast("bigint").alias("hash_rank"))
    got = hash_rank(skewed, 3, "t", group=["label"], bucket_rows=bucket_rows).select("row_id", "hash_rank")
    assert sorted(got.collect()) == sorted(want.collect())


def test_split_is_disjoint_complete_and_stable(skewed):
    runs = [sorted(split(skewed.repartition(n), 5).select("row_id", "split").collect()) for n in (1, 4, 200)]
    assert runs[0] == runs[1] == runs[2]
    assert len(runs[0]) == 1000 and {r["split"] for r in runs[0]} == {"train", "val", "test"}


def test_stratified_quotas_are_exact(skewed):
    counts = {(r["label"], r["split"]): r["count"] for r in split_stratified(skewed, 5).groupBy("label", "split").count().collect()}
    for label, n in ((0, 800), (1, 50), (4, 50)):
        assert counts[label, "train"] == n * 7 // 10
        assert counts[label, "val"] == n * 8 // 10 - n * 7 // 10


def test_subset_caps_every_class(skewed):
    counts = {r["label"]: r["count"] for r in subset(skewed, 60, 1).groupBy("label").count().collect()}
    assert counts == {0: 60, 1: 50, 2: 50, 3: 50, 4: 50}


def test_shares_are_decimal_and_bounded():
    assert int(fraction(0.29) * 100) == 29
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            fraction(bad)
