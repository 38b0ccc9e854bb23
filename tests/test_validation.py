import pytest
from pyspark.sql import functions as F

from siltmark.operators.ml import MLClassifier
from siltmark.operators.novelty import calibrate, detect_unknown_by_class
from siltmark.operators.split import split
from siltmark.plans.experiment import run_tasks


@pytest.fixture(scope="module")
def sides(skewed):
    rows = split(skewed, 5).cache()
    return [rows.where(F.col("split") == s) for s in ("train", "val", "test")]


def test_the_kept_perceptron_has_the_lowest_validation_loss(sides):
    train, val, _ = sides
    model = MLClassifier("mlp", hidden=(6,), max_iter=30, seed=1, check_every=5).fit(train, val)
    assert 1 <= len(model.val_losses) <= 6
    assert model.validation_loss(val) == pytest.approx(min(model.val_losses))


def test_a_fit_stops_when_validation_gets_worse(sides):
    """Validation rows with shifted labels: what is learnt makes their loss grow."""
    train, val, _ = sides
    wrong = val.withColumn("label", (F.col("label") + 1) % 5)
    model = MLClassifier("mlp", hidden=(6,), max_iter=100, seed=1, check_every=5, patience=2).fit(train, wrong)
    best = model.val_losses.index(min(model.val_losses))
    assert len(model.val_losses) == best + 3 < 20
    assert model.validation_loss(wrong) == pytest.approx(min(model.val_losses))
    assert model.max_iter == 100


def test_validation_picks_the_penalty(sides):
    train, val, _ = sides
    model = MLClassifier("logreg", max_iter=10).fit(train, val)
    assert len(model.val_losses) == 3
    assert model.validation_loss(val) == pytest.approx(min(model.val_losses))


def test_validation_rows_of_no_known_class_decide_nothing(sides):
    train, val, _ = sides
    plain = MLClassifier("mlp", hidden=(4,), max_iter=8, seed=1).fit(train)
    other = MLClassifier("mlp", hidden=(4,), max_iter=8, seed=1).fit(train, val.withColumn("label", F.lit(99)))
    assert other.losses == plain.losses and other.val_losses == []


def test_tasks_use_the_validation_rows_so_far(spark, sides, monkeypatch):
    seen = []
    fit = MLClassifier._fit_validated
    monkeypatch.setattr(MLClassifier, "_fit_validated", lambda self, rows, val, w: seen.append(sorted(r[0] for r in val.select("label").distinct().collect())) or fit(self, rows, val, w))
    task = F.when(F.col("label") < 2, 1).otherwise(2)
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2]).withColumn("task_id", task)
    make = lambda: MLClassifier("mlp", class_ids=list(range(5)), hidden=(6,), max_iter=10, seed=1)
    cells = run_tasks(rows, [1, 2], "replay", make, 20, 1, validate=True)
    assert seen == [[0, 1], [0, 1, 2, 3, 4]]
    assert {(r["after_task"], r["eval_task"]) for r in cells.collect()} == {(1, 1), (2, 1), (2, 2)}


def test_calibration_keeps_the_wanted_rate(spark):
    rows = [(0, i / 200.0) for i in range(200)] + [(1, 0.75)] * 50 + [(2, None)] * 3 + [(2, float("nan"))]
    val = spark.createDataFrame(rows, "pred int, max_prob double")
    got = {r["pred"]: (r["n_rows"], r["threshold"]) for r in calibrate(val, 0.1).collect()}
    assert set(got) == {0, 1}  # a class without scores has no threshold
    assert got[1] == (50, 0.75)  # equal scores: none of them may fall below
    n, t = got[0]
    assert n == 200 and sum(i / 200.0 < t for i in range(200)) <= 20 < sum(i / 200.0 < t + 1 / 1024 for i in range(200)) + 5
    assert {r["threshold"] for r in calibrate(val.where("pred = 1"), 0.0).collect()} == {0.75}
    with pytest.raises(ValueError):
        calibrate(val, 1.0)
    assert calibrate(val.limit(0), 0.1).count() == 0


def test_unknown_by_class_uses_the_default_elsewhere(spark):
    rows = [(0, 0.4), (0, 0.6), (7, 0.4), (7, 0.6), (0, None), (0, float("nan"))]
    df = spark.createDataFrame(rows, "pred int, max_prob double")
    th = spark.createDataFrame([(0, 0.7)], "pred int, threshold double")
    got = [(r["pred"], r["max_prob"], r["is_unknown"]) for r in detect_unknown_by_class(df, th, 0.5).where("max_prob < 1").collect()]
    assert sorted(got) == [(0, 0.4, True), (0, 0.6, True), (7, 0.4, True), (7, 0.6, False)]
    assert detect_unknown_by_class(df, th, 0.5).where("max_prob is null or isnan(max_prob)").select("is_unknown").distinct().collect() == [(True,)]
