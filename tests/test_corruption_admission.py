import pytest
from pyspark.sql import functions as F

from siltmark.operators.admission import (
    Defence, Policy, admit, admit_each, anomaly_score, audit_buffer, confidence_signal, secure_replay,
)
from siltmark.operators.classifier import PrototypeClassifier
from siltmark.operators.corruption import apply_label_flip, apply_trigger, conditions, perturb_features
from siltmark.operators.neighbours import knn_consistency
from siltmark.operators.prepare import Scaler
from siltmark.operators.tasks import replay_buffer


@pytest.mark.parametrize("rate,changed", [("0", 0), ("0.05", 5), ("0.29", 29), ("1", 100)])
def test_flip_changes_exactly_the_requested_share(spark, rate, changed):
    df = spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") % 4).cast("int").alias("label"))
    c = apply_label_flip(df, rate, 7)
    diff = c.data.where("label <> label_poisoned")
    assert diff.count() == changed == c.log.count() == c.data.where("is_poisoned").count()
    assert c.data.count() == 100 and sorted(c.data.select("row_id", "label").collect()) == sorted(df.collect())
    s = c.summary.head()
    assert (s["changed"], s["eligible"], s["total"], s["seed"]) == (changed, 100, 100, 7)
    assert float(s["achieved"]) == changed / 100 and float(s["requested"]) == float(rate)
    assert {r["row_id"] for r in c.log.collect()} == {r["row_id"] for r in diff.collect()}


def test_allowed_classes_bound_source_and_target(skewed):
    c = apply_label_flip(skewed.select("row_id", "label"), "0.5", 1, [1, 2, 3])
    bad = c.data.where("is_poisoned")
    assert bad.count() == 75
    assert {r[0] for r in bad.select("label").union(bad.select("label_poisoned")).distinct().collect()} <= {1, 2, 3}


def test_flip_rejects_bad_arguments(skewed):
    for args in (("1.5", 1, None), ("-0.1", 1, None), ("0.1", 1, [3])):
        with pytest.raises(ValueError):
            apply_label_flip(skewed, *args)


def test_flip_is_independent_of_partitioning(skewed):
    runs = [sorted(apply_label_flip(skewed.select("row_id", "label").repartition(n), "0.1", 3).log.collect()) for n in (1, 30)]
    assert runs[0] == runs[1]


def test_conditions_nest_and_equal_single_runs(skewed):
    rows = skewed.select("row_id", "label")
    spread = conditions(rows, ["0", "0.05", "0.1"], 3)
    picked = {c: {r["row_id"] for r in spread.where((F.col("condition") == c) & F.col("is_poisoned")).collect()} for c in ("clean", "flip_0.05", "flip_0.1")}
    assert picked["clean"] == set() and picked["flip_0.05"] < picked["flip_0.1"] and len(picked["flip_0.1"]) == 100
    one = sorted(apply_label_flip(rows, "0.1", 3).data.select("row_id", "label_poisoned").collect())
    assert sorted(spread.where("condition = 'flip_0.1'").select("row_id", "label_poisoned").collect()) == one


def test_perturbation_is_bounded_and_logged(skewed):
    out = perturb_features(skewed, ["value"], "0.2", 0.5, 1, {"value": 10.0}, bounds={"value": (0.0, 999.0)})
    moved = out.where("value <> value_poisoned")
    assert out.where("is_poisoned").count() == 200 and 190 <= moved.count() <= 200
    assert moved.agg(F.max(F.abs(F.col("value") - F.col("value_poisoned")))).head()[0] <= 5.0
    assert out.where("not is_poisoned and value <> value_poisoned").count() == 0


def test_trigger_respects_target_and_time_range(skewed):
    lo, hi = "2023-11-14 22:13:20", "2023-11-15 00:00:00"
    out = apply_trigger(skewed, {"value": -1.0}, 0, "1", 1, time_range=("ts", lo, hi))
    hit = out.where("is_poisoned")
    assert hit.count() == skewed.where((F.col("label") != 0) & F.col("ts").between(lo, hi)).count() > 0
    assert hit.where("label_poisoned <> 0 or value_poisoned <> -1.0 or label = 0").count() == 0


@pytest.fixture(scope="module")
def attacked(skewed):
    """Classes 0-3 are known; class 4 is new; a tenth of the labels is flipped."""
    known = skewed.where("label < 4")
    model = PrototypeClassifier().fit(known)
    c = apply_label_flip(skewed.select("row_id", "features", "label"), "0.1", 5)
    cand = c.data.select("row_id", "features", F.col("label").alias("truth"), F.col("label_poisoned").alias("label"), "is_poisoned")
    return cand, known, model


def test_controller_stops_flips_and_holds_novelty(attacked):
    cand, known, model = attacked
    out = admit(cand, Defence.fit(model, known, Policy(0.5, 6.0, None, 1.0)))
    assert out.count() == cand.count()
    assert {r[0] for r in out.select("decision").distinct().collect()} <= {"admit", "quarantine", "reject"}
    assert out.where("is_poisoned and decision = 'admit'").count() == 0
    # Rows of the new class are held, whatever label they claim; none is dropped.
    assert out.where("truth = 4 and decision <> 'quarantine'").count() == 0
    clean = out.where("not is_poisoned and truth < 4")
    assert clean.where("decision = 'admit'").count() > 0.95 * clean.count()


def test_each_policy_equals_its_own_run(attacked):
    cand, known, model = attacked
    policies = {"a": Policy(None, None, None, 1.0), "b": Policy(0.5, 1.0, 3.0, 0.9)}
    every = admit_each(cand, model, known, policies)
    for name, p in policies.items():
        one = sorted(admit(cand, Defence.fit(model, known, p)).select("row_id", "decision", "reason").collect())
        assert sorted(every.where(F.col("setting") == name).select("row_id", "decision", "reason").collect()) == one


def test_secure_replay_and_buffer_audit(attacked):
    cand, known, model = attacked
    d = Defence.fit(model, known, Policy(0.5, 6.0, None, 1.0))
    assert secure_replay(cand, d, 20, 1).where("is_poisoned").count() == 0
    buf = replay_buffer(cand, 20, 1)
    kept, evicted = audit_buffer(buf, d)
    assert kept.count() + evicted.count() == buf.count() and kept.where("is_poisoned").count() == 0
    assert evicted.where("is_poisoned").count() == buf.where("is_poisoned").count() > 0


def test_signals_by_hand(spark, attacked):
    cand, known, model = attacked
    r = confidence_signal(model.predict_proba(cand.where("label = 4").limit(1)), model).head()
    assert r["claimed_prob"] is None
    s = Scaler(("x", "y"), (0.0, 10.0), (1.0, 2.0))
    df = spark.createDataFrame([(1.0, 4.0)], "x double, y double")
    assert anomaly_score(df, s).head()["anomaly"] == 3.0


@pytest.mark.parametrize("block_rows", [37, 1000])
def test_neighbours_are_exact_on_both_paths(skewed, block_rows):
    rows = skewed.where("row_id < 200").select("row_id", "features", "label")
    trusted = skewed.where("row_id >= 150 and row_id < 290").select("row_id", "features", "label")
    a = sorted(knn_consistency(rows, trusted, 5).collect())
    b = sorted(knn_consistency(rows, trusted, 5, limit=10, block_rows=block_rows).select("row_id", "label", "agree", "n_neighbours", "knn_share").collect())
    assert [tuple(x) for x in a] == [tuple(x) for x in b]
    ref = [(r["row_id"], r["label"], r["features"]) for r in trusted.collect()]
    for r in rows.where("row_id % 40 = 7").collect():
        near = sorted((sum((x - y) ** 2 for x, y in zip(f, r["features"])), i, l) for i, l, f in ref if i != r["row_id"])[:5]
        got = [x for x in a if x["row_id"] == r["row_id"]][0]
        assert got["agree"] == sum(l == r["label"] for _, _, l in near) and got["n_neighbours"] == 5


def test_the_log_of_a_perturbation_needs_no_marked_table(spark, monkeypatch):
    """The same log from the chosen rows alone, also where the first key range is too narrow; every id is made once."""
    from siltmark.operators import selection
    from siltmark.operators.corruption import change_log, perturb_features, perturb_log

    df = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("row_id"), (F.col("id") % 9 + 0.5).alias("v"))
    for rate in ("0", "0.02", "0.5", "1"):
        marked = perturb_features(df, ["v"], rate, 0.5, 7, {"v": 2.0}, bounds={"v": (1.0, 8.0)})
        want = sorted(tuple(r) for r in change_log(marked, "perturb", 7).collect())
        got = sorted(tuple(r) for r in perturb_log(df, ["v"], rate, 0.5, 7, {"v": 2.0}, bounds={"v": (1.0, 8.0)}).collect())
        assert got == want and (rate == "0") == (not want)
    few = selection.lowest_rows(df, lambda n: F.floor(n / 50), 7, "s", slack=-10.0)
    assert sorted(r[0] for r in few.collect()) == sorted(r[0] for r in selection.select_lowest(df, 100, 7, "s").collect())
    plan = perturb_features(df, ["v"], "0.02", 0.5, 7, {"v": 2.0}).where("is_poisoned").select("v")._jdf.queryExecution().optimizedPlan().toString()
    assert "struct(h" not in plan
