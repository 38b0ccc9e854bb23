import json

import pytest
from pyspark.sql import functions as F

from siltmark.operators.classifier import PrototypeClassifier
from siltmark.operators.evaluate import (
    across_seeds, attack_success, classification_metrics, compare_conditions, confusion, confusion_wide, continual_metrics,
    efficiency, forgetting, metrics_json, new_class_metrics, novelty_metrics, per_class, security_metrics, tradeoff,
)
from siltmark.operators.novelty import class_radii, detect_far, detect_unknown, label_unknown, quarantine, release, threshold_sweep


@pytest.fixture()
def scored(spark):
    data = [(1, [0.5, 0.5], 3), (2, [0.499999, 0.3], 3), (3, [0.9, 0.1], 3), (4, None, 3)]
    return spark.createDataFrame(data, "row_id bigint, probs array<double>, pred int")


def test_threshold_is_strict_and_the_input_is_kept(scored):
    out = label_unknown(detect_unknown(scored, 0.5))
    got = {r["row_id"]: (r["is_unknown"], r["final_pred"], r["pred"]) for r in out.collect()}
    assert got[1] == (False, 3, 3) and got[2] == (True, -1, 3) and got[3] == (False, 3, 3)


def test_sweep_equals_separate_runs(spark):
    df = spark.range(500).select((F.col("id") % 97 / 97.0).alias("max_prob"), (F.col("id") % 3 == 0).alias("is_novel"))
    steps = [0.0, 10 / 97.0, 0.5, 1.0]
    got = {r["threshold"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in threshold_sweep(df, steps).collect()}
    for t in steps:
        m = novelty_metrics(df.withColumn("is_unknown", F.col("max_prob") < t)).head()
        assert got[t] == (m["tp"], m["fp"], m["fn"], m["tn"])


def test_far_rows_and_release(skewed):
    known = skewed.where("label < 4")
    model = PrototypeClassifier().fit(known)
    radii = class_radii(known, model, 1.0)
    out = detect_far(model.predict(skewed), model, radii)
    assert {r["label"] for r in out.where("is_far").select("label").distinct().collect()} == {4}
    assert out.where("is_far_from_all != is_far").count() == 0
    held = quarantine(out.withColumn("decision", F.when(F.col("is_far"), "quarantine").otherwise("admit")), 2)
    assert held.count() == 50 and held.where("released_task is not null").count() == 0
    assert release(held, 50, 10.0, 3).where("released_task = 3").count() == 50
    assert release(held, 51, 10.0, 3).count() == 0 and release(held, 1, 0.1, 3).count() == 0


@pytest.fixture()
def preds(spark):
    """Class 2 is never predicted, class 9 never true, -1 is unknown."""
    pairs = [(0, 0)] * 5 + [(0, 1)] + [(1, 1)] * 2 + [(1, -1)] * 2 + [(2, 0)] + [(1, 9)]
    return spark.createDataFrame(pairs, "label int, pred int")


def test_confusion_and_per_class(preds):
    cm = confusion(preds)
    assert cm.agg(F.sum("n")).head()[0] == 12
    got = {r["class_id"]: r for r in per_class(cm).collect()}
    assert set(got) == {0, 1, 2, 9}
    assert (got[0]["tp"], got[0]["support"], got[0]["predicted"]) == (5, 6, 6)
    assert (got[2]["precision"], got[2]["recall"], got[2]["f1"], got[2]["support"]) == (0.0, 0.0, 0.0, 1)
    assert got[9]["support"] == 0 and got[1]["recall"] == pytest.approx(2 / 5)
    wide = {r["y"]: r for r in confusion_wide(cm, [0, 1, 2, 9]).collect()}
    assert wide[1]["pred_unknown"] == 2 and wide[1]["pred_9"] == 1 and wide[2]["pred_0"] == 1


def test_classification_metrics(preds):
    m = classification_metrics(preds).head()
    assert m["accuracy"] == pytest.approx(7 / 12) and m["coverage"] == pytest.approx(10 / 12)
    assert m["accuracy_covered"] == pytest.approx(7 / 10) and m["n_rows"] == 12
    f1 = [2 * 5 / 12, 2 * 2 / (5 + 3), 0, 0]
    assert m["macro_f1"] == pytest.approx(sum(f1) / 4)


def test_rows_without_label_or_prediction_count_but_name_no_class(spark, preds):
    more = preds.union(spark.createDataFrame([(None, 0), (0, None)], "label int, pred int"))
    m = classification_metrics(more).head()
    assert m["n_rows"] == 14 and m["accuracy"] == pytest.approx(7 / 14) and m["coverage"] == pytest.approx(11 / 14)
    assert {r["class_id"] for r in per_class(confusion(more)).collect()} == {0, 1, 2, 9}
    plan = classification_metrics(more)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_spark_evaluator_agrees_on_accuracy(preds):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    d = preds.where("pred >= 0").select(F.col("label").cast("double"), F.col("pred").cast("double").alias("prediction"))
    acc = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="accuracy").evaluate(d)
    assert classification_metrics(preds).head()["accuracy_covered"] == pytest.approx(acc)


def matrix(spark):
    cells = [(1, 1, 0.9), (2, 1, 0.6), (2, 2, 0.8), (3, 1, 0.7), (3, 2, 0.85), (3, 3, 0.5)]
    return spark.createDataFrame([("replay", a, e, s) for a, e, s in cells], "strategy string, after_task int, eval_task int, score double")


def test_forgetting(spark):
    two = continual_metrics(matrix(spark)).head()
    assert (two["task1_before"], two["task1_after"], two["task2_score"]) == (0.9, 0.6, 0.8)
    assert two["forgetting"] == pytest.approx(0.3)
    all_ = forgetting(matrix(spark)).head()
    # Task 1 lost 0.9 - 0.7, task 2 gained 0.05: forgetting may be negative for a task.
    assert all_["average_forgetting"] == pytest.approx((0.2 - 0.05) / 2)
    assert all_["old_class_retention"] == pytest.approx(0.775) and all_["new_class_score"] == 0.5


def test_two_task_forgetting_is_before_minus_after(spark):
    m = matrix(spark).where("after_task <= 2")
    assert forgetting(m).head()["average_forgetting"] == pytest.approx(continual_metrics(m).head()["forgetting"])


def decisions(spark):
    data = [
        (1, "admit", True, False, None), (2, "reject", True, False, None), (3, "quarantine", True, False, None),
        (4, "admit", False, False, None), (5, "reject", False, False, None), (6, "quarantine", False, True, 3),
        (7, "quarantine", False, True, None), (8, "reject", False, True, None), (9, "admit", False, True, None),
    ]
    return spark.createDataFrame(data, "row_id bigint, decision string, is_poisoned boolean, is_new_class boolean, released_task int")


def test_security_and_new_class_metrics(spark):
    d = decisions(spark)
    s = security_metrics(d).head()
    assert s["poison_admission_rate"] == pytest.approx(1 / 3) and s["detection_tpr"] == pytest.approx(2 / 3)
    assert s["clean_rejection_rate"] == pytest.approx(2 / 6) and s["detection_fpr"] == pytest.approx(4 / 6)
    log = d.where("is_poisoned").select("row_id")
    assert security_metrics(d, log).head() == s
    n = new_class_metrics(d).head()
    assert (n["n_rows"], n["quarantine_rate"], n["rejection_rate"], n["eventual_learning_rate"]) == (4, 0.5, 0.25, 0.5)


def test_zero_denominators_are_zero(spark):
    none = security_metrics(decisions(spark).where("not is_poisoned")).head()
    assert none["poison_admission_rate"] == 0.0 and none["n_poisoned"] == 0


def test_comparison_seeds_tradeoff_and_json(spark):
    m = spark.createDataFrame([(0.0, "a", 0.9), (0.1, "a", 0.7), (0.0, "b", 1.0), (0.1, "b", 1.5)], "rate double, metric string, value double")
    deltas = {(r["rate"], r["metric"]): r["delta"] for r in compare_conditions(m).collect()}
    assert deltas[0.1, "a"] == pytest.approx(-0.2) and deltas[0.0, "b"] == 0.0
    s = {r["metric"]: r for r in across_seeds(m).collect()}
    assert s["a"]["mean"] == pytest.approx(0.8) and s["a"]["n_runs"] == 2 and s["b"]["spread"] == pytest.approx(0.5 / 2**0.5)
    t = {r["rate"]: r for r in tradeoff(m, ["a", "b"], "rate").collect()}
    assert t[0.1]["b"] == 1.5
    j = {r["rate"]: json.loads(r["metrics"]) for r in metrics_json(m, ["rate"]).collect()}
    assert j[0.1] == {"a": 0.7, "b": 1.5}


def test_attack_success_and_efficiency(spark):
    df = spark.createDataFrame([(0, 0, True), (1, 0, True), (1, 1, True), (1, 0, False)], "label int, pred int, is_triggered boolean")
    r = attack_success(df, 0).head()
    assert (r["n_triggered"], r["n_success"], r["attack_success_rate"]) == (2, 1, 0.5)
    e = efficiency(df, {"parameters": 6, "bytes": 48}, 1.5).head()
    assert (e["replay_rows"], e["replay_classes"], e["model_bytes"], e["update_seconds"]) == (4, 2, 48, 1.5)
