import itertools

import pytest
from pyspark.sql import functions as F

from siltmark.operators.classifier import PrototypeClassifier
from siltmark.operators.split import split
from siltmark.operators.tasks import (
    make_tasks, merge_buffer, poison_persistence, replay_buffer, task_classes_df, task_manifest, training_set,
)
from siltmark.plans.experiment import Params, run, run_both, run_tasks

TASKS = {1: [0, 1], 2: [2], 3: [3]}


@pytest.fixture(scope="module")
def tasked(spark, skewed):
    return make_tasks(split(skewed, 4), task_classes_df(spark, TASKS))


def test_tasks_are_class_disjoint_and_complete(spark, skewed, tasked):
    rows, holdout = tasked
    pairs = {tuple(r) for r in rows.select("task_id", "label").distinct().collect()}
    assert pairs == {(1, 0), (1, 1), (2, 2), (3, 3)}
    assert {r["label"] for r in holdout.select("label").distinct().collect()} == {4}
    assert rows.count() + holdout.count() == skewed.count()
    with pytest.raises(ValueError):
        task_classes_df(spark, {1: [0], 2: [0]})


def test_manifest_counts_sum_to_the_table(tasked):
    rows, _ = tasked
    m = task_manifest(rows, 4).collect()
    assert sum(r["n_rows"] for r in m) == rows.count()
    assert {tuple(r["classes"]) for r in m if r["task_id"] == 1} == {(0, 1)}


def ids(df):
    return sorted(r[0] for r in df.select("row_id").collect())


def test_buffer_is_bounded_and_merge_order_is_irrelevant(skewed):
    rows = skewed.select("row_id", "label")
    whole = ids(replay_buffer(rows, 20, 9))
    assert len(whole) == 100
    parts = [rows.where(F.col("row_id") % 3 == i) for i in range(3)]
    for order in list(itertools.permutations(range(3)))[::3]:
        buf = replay_buffer(parts[order[0]], 20, 9)
        for i in (*order[1:], order[0]):
            buf = merge_buffer(buf, parts[i], 20, 9)
        assert ids(buf) == whole


def test_training_set_strategies(tasked):
    rows, _ = tasked
    fine = training_set(rows, 2, "finetune", 10, 1)
    assert {r["label"] for r in fine.select("label").distinct().collect()} == {2}
    counts = {(r["origin"], r["label"]): r["count"] for r in training_set(rows, 2, "replay", 10, 1).groupBy("origin", "label").count().collect()}
    assert counts["replay", 0] == 10 and counts["replay", 1] == 10 and ("replay", 2) not in counts
    with pytest.raises(ValueError):
        training_set(rows, 2, "other")


def test_persistence(spark):
    buf = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3)], "buffer_version int, row_id bigint")
    log = spark.createDataFrame([(2,), (99,)], "row_id bigint")
    got = {r["buffer_version"]: r["share"] for r in poison_persistence(buf, log).collect()}
    assert got == {1: 0.5, 2: 0.5}


def test_one_scan_matrix_equals_the_task_loop(tasked):
    rows, _ = tasked
    fast = sorted(tuple(r) for r in run_both(rows, [1, 2, 3], 1.0, 10, 2).select("strategy", "after_task", "eval_task", "score", "n_rows").collect())
    slow = []
    for s in ("finetune", "replay"):
        slow += [tuple(r) for r in run_tasks(rows, [1, 2, 3], s, PrototypeClassifier, 10, 2).collect()]
    assert fast == sorted(slow)
    scores = {r[:3]: r[3] for r in fast}
    # On separable classes replay keeps task 1 and plain fine-tuning loses it.
    assert scores["replay", 3, 1] == 1.0 and scores["finetune", 3, 1] == 0.0


def test_one_call_writes_every_table_and_the_manifest(spark, skewed, folder):
    out = folder + "/run"
    p = Params("smoke", "generated rows", 4, TASKS, ["0", "0.2"], 0.5, 1.0, 10, "abc123", out)
    tables = run(skewed, p)
    m = tables["manifest"].head()
    for f in ("experiment", "commit", "dataset", "split", "class_map", "seeds", "model", "hyperparameters", "poisoning", "novelty", "metrics_location", "limitations", "run_at"):
        assert m[f]
    assert spark.read.json(out + "/manifest").head()["commit"] == "abc123"
    acc = {float(r["rate"]): r["value"] for r in tables["metrics"].where("metric = 'accuracy'").collect()}
    assert acc[0.0] == 1.0
    assert {r["condition"] for r in spark.read.parquet(out + "/conditions").select("condition").distinct().collect()} == {"clean", "flip_0.2"}


def test_a_perceptron_continues_from_task_to_task(spark, skewed, monkeypatch):
    from siltmark.operators.ml import MLClassifier
    from siltmark.plans.experiment import run_tasks

    rows = skewed.withColumn("split", F.when(F.col("row_id") % 4 == 0, "test").otherwise("train"))
    rows = rows.withColumn("task_id", F.when(F.col("label") < 2, 1).otherwise(2))
    started = []
    fit = MLClassifier._fit
    monkeypatch.setattr(MLClassifier, "_fit", lambda self, rows, weights: started.append(weights is not None) or fit(self, rows, weights))
    make = lambda: MLClassifier("mlp", class_ids=[0, 1, 2, 3, 4], hidden=(4,), max_iter=10, seed=3)
    cells = {(r["after_task"], r["eval_task"]): r["score"] for r in run_tasks(rows, [1, 2], "replay", make, cap=20, seed=1).collect()}
    assert started == [False, True] and set(cells) == {(1, 1), (2, 1), (2, 2)}
    assert cells[1, 1] > 0.9


def test_buffers_from_task_to_task(spark, skewed, folder):
    """A version is the buffer of all rows so far; with a defence poison stays out of every one."""
    from siltmark.operators.admission import Defence, Policy
    from siltmark.operators.classifier import PrototypeClassifier
    from siltmark.plans.experiment import run_buffers

    task = F.when(F.col("label") < 2, 1).when(F.col("label") < 4, 2)
    rows = skewed.withColumn("task_id", task).where("task_id IS NOT NULL").withColumn("truth", F.col("label"))
    rows = rows.withColumn("label", F.when(F.col("row_id") % 7 == 0, (F.col("label") + 1) % 4).otherwise(F.col("label")))
    found = run_buffers(rows, [1, 2], folder + "/all", 10, 3)
    want = {(1, r["row_id"]) for r in replay_buffer(rows.where("task_id = 1"), 10, 3).collect()} | {(2, r["row_id"]) for r in replay_buffer(rows, 10, 3).collect()}
    assert {(r["buffer_version"], r["row_id"]) for r in found.collect()} == want
    assert found.where("label <> truth").count() > 0
    trusted = skewed.where("label < 4")
    defence = Defence.fit(PrototypeClassifier().fit(trusted), trusted, Policy(0.5, 6.0, None, 1.0))
    kept = run_buffers(rows, [1, 2], folder + "/kept", 10, 3, defence)
    assert kept.where("label <> truth").count() == 0 and kept.where("buffer_version = 2").count() > 20


def test_a_buffer_without_rows_is_reported(spark, skewed, folder):
    """A defence that admits no row leaves empty versions; each comes with zero rows and no share."""
    from siltmark.operators.admission import Defence, Policy
    from siltmark.operators.classifier import PrototypeClassifier
    from siltmark.plans.experiment import run_buffers

    rows = skewed.where("label < 3").withColumn("task_id", F.when(F.col("label") < 2, 1).otherwise(2))
    model = PrototypeClassifier().fit(rows)
    defence = Defence.fit(model, rows, Policy(1.1, None, None, 1.0))
    log = rows.where("row_id % 7 = 0").select("row_id")
    kept = run_buffers(rows, [1, 2], folder + "/kept", 10, 3, defence)
    assert sorted(tuple(r) for r in poison_persistence(kept, log, versions=[1, 2]).collect()) == [(1, 0, 0, None), (2, 0, 0, None)]
    second = run_buffers(rows.where("task_id = 2"), [1, 2], folder + "/second", 10, 3)
    found = {r[0]: r[1] for r in poison_persistence(second, log, versions=[1, 2]).collect()}
    assert found == {1: 0, 2: 10 * rows.where("task_id = 2").select("label").distinct().count()}
