import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmark.operators import neighbours
from siltmark.operators.buckets import choose, plant, recall_of
from siltmark.operators.neighbours import knn_consistency, nearest_rows

K = 5


def frame(spark, x, first=0):
    rows = [(first + i, i % 3, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "row_id bigint, label int, features array<float>")


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors near 40 centres; a third of the trusted rows are one and the same vector."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 12)) * 4
    draw = lambda n: centres[rng.integers(0, 40, n)] + 0.3 * rng.standard_normal((n, 12))
    trusted = np.concatenate([draw(4000), np.tile(centres[0], (2000, 1))])
    return frame(spark, draw(600), 10_000).cache(), frame(spark, trusted).cache()


def neighbours_of(df):
    return {r["row_id"]: [n["tid"] for n in r["_n"]] for r in df.collect()}


def test_buckets_reach_the_wanted_recall(clustered):
    cand, ref = clustered
    want = neighbours_of(nearest_rows(cand, ref, K))
    got = neighbours_of(nearest_rows(cand, ref, K, recall=0.95, leaf_rows=128))
    hits = sum(len(set(got.get(i, ())) & set(n)) for i, n in want.items())
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_buckets_compare_a_part_of_all_pairs(clustered):
    cand, ref = clustered
    forest = choose(cand, ref, cand.count(), ref.count(), 12, K, 0.95, 128)
    assert forest is not None and forest.depth == 6
    assert len(forest.directions) * forest.n_leaves < 1 << forest.depth


def test_hot_leaves_are_cut_into_blocks(clustered):
    """Blocks of 50 rows inside leaves: the same neighbours as without."""
    cand, ref = clustered
    a = neighbours_of(nearest_rows(cand, ref, K, recall=0.95, leaf_rows=256))
    b = neighbours_of(nearest_rows(cand, ref, K, block_rows=50, recall=0.95, leaf_rows=256))
    assert a == b


def test_vectors_without_structure_are_compared_exactly(spark):
    x = np.random.default_rng(2).standard_normal((700, 48))
    cand, ref = frame(spark, x[:200], 5_000), frame(spark, x[200:])
    assert choose(cand, ref, 200, 500, 48, K, 0.99, 8) is None
    assert neighbours_of(nearest_rows(cand, ref, K, recall=0.99, leaf_rows=8)) == neighbours_of(nearest_rows(cand, ref, K))


def test_searched_leaves_differ_and_start_with_the_own():
    x = np.random.default_rng(1).standard_normal((300, 6))
    forest = plant(x, 3_000, 3, 64)
    looked = forest.leaves(x, 9)
    assert (looked[:, :, 0] == forest.leaves(x, 1)[:, :, 0]).all()
    assert all(len(set(row)) == 9 for table in looked.transpose(1, 0, 2) for row in table)
    assert looked.min() >= 0 and looked.max() < 1 << forest.depth
    assert recall_of(forest, x, np.arange(300), x) == 1.0


def test_equal_trusted_vectors_give_the_lowest_ids(spark):
    ref = frame(spark, np.ones((400, 4)))
    cand = frame(spark, np.ones((3, 4)), 1)  # ids 1 to 3 are trusted rows as well
    got = neighbours_of(nearest_rows(cand, ref, 3, recall=0.9, leaf_rows=50))
    assert got == {1: [0, 2, 3], 2: [0, 1, 3], 3: [0, 1, 2]}


def test_broadcast_is_bounded_by_bytes(spark, monkeypatch):
    x = np.random.default_rng(3).standard_normal((60, 4))
    cand, ref = frame(spark, x[:20], 100), frame(spark, x[20:])
    seen = []
    monkeypatch.setattr(neighbours, "small_table", lambda df, limit: seen.append(limit))
    monkeypatch.setattr(neighbours, "TRUSTED_BYTES", 8 * 4 * 10)
    votes = knn_consistency(cand, ref, 3)
    assert seen == [10] and votes.count() == 20


def test_missing_vectors_have_no_neighbours(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 1, None), (4, 1, [float("nan"), 1.0])]
    ref = spark.createDataFrame(rows, "row_id bigint, label int, features array<float>")
    cand = ref.withColumn("row_id", F.col("row_id") + 10)
    got = {r["row_id"]: r["n_neighbours"] for r in knn_consistency(cand, ref, 3, limit=1, recall=0.9, leaf_rows=1).collect()}
    assert got == {11: 2, 12: 2, 13: 0, 14: 0}


def test_nearest_of_a_block_hold_no_matrix_of_pairs():
    """Memory follows the trusted rows alone; ties go to the lower id, odd vectors are nobody's neighbours."""
    rng = np.random.default_rng(3)
    x, trusted = rng.standard_normal((300, 4)), rng.standard_normal((20_000, 4))
    trusted[500:600] = trusted[400]
    x[0], trusted[9] = trusted[400], np.nan
    ids, tids = np.arange(300), np.arange(20_000)[::-1].copy()
    tracemalloc.start()
    found = list(neighbours.top_k(x, ids, trusted, tids, tids % 7, 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20  # 300 x 20,000 distances alone are 48 MB
    assert [j for j, *_ in found] == list(range(300))
    for j, d2, near, labels in found:
        true = sorted((float(((t - x[j]) ** 2).sum()), int(i)) for t, i in zip(trusted[::-1], tids[::-1]) if i != j and np.isfinite(t).all())[:5] if j < 3 else None
        assert true is None or near.tolist() == [i for _, i in true]
        assert (labels == near % 7).all() and (np.diff(d2) >= 0).all()
    assert len(next(iter(neighbours.top_k(x[:1], ids[:1], trusted[:3], tids[:3], tids[:3], 5)))[2]) == 3
