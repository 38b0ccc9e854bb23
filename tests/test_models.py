import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmark.operators.classifier import PrototypeClassifier, fit_many
from siltmark.operators.ml import MLClassifier, score_with


@pytest.fixture(scope="module")
def model(skewed):
    return PrototypeClassifier().fit(skewed, val=skewed)


def test_prototypes_are_class_means(skewed, model):
    pdf = skewed.where("label = 3").toPandas()
    assert np.allclose(model.centres[model.class_ids.index(3)], np.stack(pdf.features).astype(float).mean(axis=0))
    assert dict((c, s[0]) for c, s in model.stats.items()) == {0: 800, 1: 50, 2: 50, 3: 50, 4: 50}
    assert dict((m, v) for _, m, v in model.trace)["val_accuracy"] == 1.0


def test_probabilities_sum_to_one_and_match_class_ids(skewed, model):
    r = model.predict_proba(skewed).agg(F.min(F.size("probs")), F.max(F.abs(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x) - 1))).head()
    assert r[0] == 5 and r[1] < 1e-12
    assert model.predict(skewed).where("pred <> label").count() == 0


def test_ties_go_to_the_lowest_class_id(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0], 7), (2, [1.0, 0.0], 3)], "row_id bigint, features array<float>, label int")
    m = PrototypeClassifier().fit(rows)
    assert m.class_ids == [3, 7]
    assert m.predict(spark.createDataFrame([([0.5, 0.5],)], "features array<float>")).head()["pred"] == 3


def test_missing_vector_has_no_prediction_and_wrong_width_fails(spark, model):
    r = model.predict(spark.createDataFrame([(None,)], "features array<float>")).head()
    assert r["probs"] is None and r["pred"] is None
    with pytest.raises(Exception, match="wide"):
        model.predict(spark.createDataFrame([([1.0, 2.0],)], "features array<float>")).collect()


def test_scalar_columns_and_arrays_agree(skewed, model):
    cols = [f"f{i}" for i in range(6)]
    flat = skewed.select("row_id", "label", *[F.col("features")[i].alias(c) for i, c in enumerate(cols)])
    m = PrototypeClassifier(cols).fit(flat)
    a = {r["row_id"]: r["max_prob"] for r in m.predict(flat).collect()}
    b = {r["row_id"]: r["max_prob"] for r in model.predict(skewed).collect()}
    assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in b)
    plan = m.predict(flat)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_models_merge_and_survive_a_round_trip(spark, skewed, model, folder):
    halves = [PrototypeClassifier().fit(skewed.where(F.col("row_id") % 2 == i)) for i in (0, 1)]
    both = halves[0].merge(halves[1])
    assert np.allclose(both.centres, model.centres)
    both.save(spark, folder + "/m")
    back = PrototypeClassifier.load(spark, folder + "/m")
    assert back.centres == both.centres and back.class_ids == both.class_ids and back.version == 2
    assert back.size() == {"parameters": 30, "bytes": 240}


def test_fit_many_equals_separate_fits(skewed):
    rows = skewed.withColumn("part", F.col("row_id") % 2)
    many = fit_many(rows, "part")
    for i in (0, 1):
        assert np.allclose(many[i].centres, PrototypeClassifier().fit(rows.where(F.col("part") == i)).centres)


@pytest.mark.parametrize("kind", ["mlp", "logreg"])
def test_spark_ml_contract(spark, skewed, folder, kind):
    m = MLClassifier(kind, hidden=(8,), max_iter=30, seed=1).fit(skewed)
    scored = m.predict(skewed)
    assert scored.agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).head()[0] > 0.95
    assert scored.select(F.size("probs")).distinct().collect() == [(5,)]
    assert m.history(spark).count() == len(m.losses) > 1 and m.losses[-1] < m.losses[0]
    m.save(spark, folder + "/ml")
    back = MLClassifier.load(spark, folder + "/ml")
    assert sorted(r[0] for r in back.predict(skewed).select("max_prob").collect()) == sorted(r[0] for r in scored.select("max_prob").collect())
    assert back.size()["parameters"] > 0


def test_sequential_update_continues_from_the_weights(skewed):
    first = MLClassifier("mlp", class_ids=[0, 1, 2, 3, 4], hidden=(8,), max_iter=30, seed=1).fit(skewed.where("label < 3"))
    second = first.update(skewed.where("label >= 3"))
    assert second.class_ids == first.class_ids and second.losses[0] > first.losses[-1]
    new = second.predict(skewed.where("label >= 3")).agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).head()[0]
    assert new > 0.9


def test_user_supplied_network(skewed, model):
    centres = np.asarray(model.centres)

    def load():
        def predict(x):
            z = 2 * x.astype(float) @ centres.T - (centres**2).sum(axis=1)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return predict

    got = {r["row_id"]: r["probs"] for r in score_with(load, skewed).collect()}
    for r in model.predict_proba(skewed).collect():
        assert got[r["row_id"]] == pytest.approx(r["probs"], abs=1e-9)
