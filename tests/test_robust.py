"""Inputs the given tables do not hold: holes in vectors, colliding ids, shuffled headers."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.functions import vectors
from siltmark.operators.admission import Policy, Defence, admit
from siltmark.operators.classifier import PrototypeClassifier
from siltmark.operators.evaluate import compare_conditions, security_metrics
from siltmark.operators.neighbours import knn_consistency
from siltmark.operators.novelty import detect_unknown, label_unknown
from siltmark.operators.selection import select_lowest
from siltmark.operators.validate import percent_name
from siltmark.sources.flows import read_flows, with_row_id

INF, NAN = float("inf"), float("nan")
BAD = {10: None, 11: [NAN, 0.0], 12: [INF, 0.0], 13: [None, 0.0]}


@pytest.fixture()
def model(spark):
    rows = [(1, [0.0, 0.0], 0), (2, [4.0, 0.0], 1), (3, [NAN, 0.0], 1), (4, [0.0, 2.0], 0), (5, [4.0, 2.0], 1), (6, [9.0, 9.0], 2)]
    df = spark.createDataFrame(rows, "row_id bigint, features array<double>, label int")
    return PrototypeClassifier().fit(df), df


def test_holes_are_not_predictions(spark, model):
    fitted, _ = model
    assert fitted.centres[:2] == [[0.0, 1.0], [4.0, 1.0]]  # the row with NaN is not fitted
    rows = [(1, [0.1, 0.0], 0), *[(i, v, 0) for i, v in BAD.items()]]
    df = spark.createDataFrame(rows, "row_id bigint, features array<double>, label int").coalesce(1)
    out = {r["row_id"]: r for r in label_unknown(detect_unknown(fitted.predict(df), 0.5)).collect()}
    assert out[1]["pred"] == 0 and not out[1]["is_unknown"]
    for i in BAD:
        assert out[i]["probs"] is None and out[i]["pred"] is None and out[i]["is_unknown"] and out[i]["final_pred"] == -1


def test_ragged_vectors_are_never_reshaped(spark, model):
    for rows in ([[1.0], [1.0, 2.0, 3.0]], [[1.0, 2.0], []], [None, [1.0, 2.0, 3.0]]):
        df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)], "row_id bigint, features array<double>, label int")
        with pytest.raises(Exception, match="wide"):
            model[0].predict(df.coalesce(1)).collect()


@pytest.mark.parametrize("terms", [0, 256])
def test_columns_agree_on_both_sides_of_the_switch(spark, monkeypatch, terms):
    monkeypatch.setattr(vectors, "UNROLL_TERMS", terms)
    rows = [(1, 0.0, 0.0, 0), (2, 4.0, 0.0, 1), (3, None, 0.0, 1), (4, NAN, 1.0, 0), (5, INF, 1.0, 0)]
    df = spark.createDataFrame(rows, "row_id bigint, x double, y double, label int")
    fitted = PrototypeClassifier(["x", "y"]).fit(df)
    got = {r["row_id"]: (r["pred"], r["max_prob"] is None) for r in fitted.predict(df).collect()}
    assert got == {1: (0, False), 2: (1, False), 3: (None, True), 4: (None, True), 5: (None, True)}


def test_holes_are_held_and_a_class_without_trusted_rows_is_far(spark, model):
    fitted, train = model
    trusted = train.where("label < 2")
    defence = Defence.fit(fitted, trusted, Policy(radius_quantile=1.0))
    rows = [(1, [0.0, 0.5], 0), (2, [9.0, 9.0], 2), *[(i, v, 0) for i, v in BAD.items()]]
    out = {r["row_id"]: (r["decision"], r["reason"]) for r in admit(spark.createDataFrame(rows, train.schema).coalesce(1), defence).collect()}
    assert out[1] == ("admit", "ok") and out[2] == ("quarantine", "far")
    assert {out[i] for i in BAD} == {("quarantine", "invalid_vector")}


def test_row_ids_do_not_collide_and_rows_stay(spark):
    rows = [("a|b", "c", -0.0), ("a", "b|c", 0.0), (None, "\\N", 0.0), ("\\N", None, 0.0), ("x", "y", -0.0), ("x", "y", -0.0), ("x", "z", 1.0)]
    df = spark.createDataFrame(rows, "p string, q string, v double").repartition(3)
    out = with_row_id(df)
    ids = [r["row_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) == 7 and sum(i.endswith("-2") for i in ids) == 1
    assert sorted(str(tuple(r)[:3]) for r in out.collect()) == sorted(str(x) for x in rows)
    part = with_row_id(df, ["p"])
    assert len({r["row_id"] for r in part.collect()}) == 7
    assert sorted(r["row_id"][-2:] for r in part.where("p = 'x'").collect())[:2] == ["-2", "-3"]


def test_row_ids_shuffle_ids_and_wanted_columns_once(spark, monkeypatch):
    """One exchange without the columns nobody asks for; rows of a crowded id go another way, to the same ids."""
    text = F.concat(F.lit("text"), (F.col("id") % 50).cast("string"))
    df = spark.range(400).select(text.alias("text"), F.when(F.col("id") % 4 == 0, 0.5).otherwise(F.col("id") % 50 + 0.0).alias("v"), (F.col("id") % 3).alias("w"))
    plan = with_row_id(df).select("row_id", "w")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    want = {}
    for named in (None, ["v"]):
        for limit in (100_000, 5):
            monkeypatch.setattr("siltmark.sources.flows.COPIES_PER_CHUNK", limit)
            rows = with_row_id(df, named).collect()
            assert len({r["row_id"] for r in rows}) == 400
            assert sorted(tuple(r)[:3] for r in rows) == sorted(tuple(r) for r in df.collect())
            assert want.setdefault(str(named), sorted(r["row_id"] for r in rows)) == sorted(r["row_id"] for r in rows)


def test_csv_is_read_by_name(spark, folder):
    with open(os.path.join(folder, "a.csv"), "w") as f:
        f.write(" b , a,extra\n1.5,7,x\n-Inf,8,y\nInf,9,z\nInfinity,10,z\nNaN,11,z\nno,12,z\n")
    rows, bad = read_flows(spark, folder + "/a.csv", T._parse_datatype_string("a int, b double"))
    assert [(r["a"], str(r["b"])) for r in rows.orderBy("a").collect()] == [(7, "1.5"), (8, "-inf"), (9, "inf"), (10, "inf"), (11, "nan")]
    assert rows.columns == ["a", "b"] and [r["a"] for r in bad.collect()] == [12]
    with pytest.raises(ValueError, match="lacks"):
        read_flows(spark, folder + "/a.csv", T._parse_datatype_string("a int, c double"))


def test_selection_refuses_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a")] * 10, "row_id bigint, label string")
    with pytest.raises(ValueError, match="unique ids"):
        select_lowest(df, 5, 1, "s", group=["label"]).count()


def test_a_row_logged_twice_is_one_row(spark):
    decisions = spark.createDataFrame([(1, "admit"), (2, "reject"), (3, "admit")], "row_id bigint, decision string")
    log = spark.createDataFrame([(1,), (1,)], "row_id bigint")
    row = security_metrics(decisions, log).first()
    assert (row["n_poisoned"], row["n_clean"]) == (1, 2)


def test_conditions_compare_within_their_keys(spark):
    rows = [(1, 0.0, "f1", 1.0), (1, 0.1, "f1", 0.5), (2, 0.0, "f1", 2.0), (2, 0.1, "f1", 0.5), (2, 0.1, "new", 3.0)]
    df = spark.createDataFrame(rows, "seed int, rate double, metric string, value double")
    got = sorted((r["seed"], r["metric"], r["delta"]) for r in compare_conditions(df, keys=["seed"]).where("rate > 0").collect() if r["metric"] == "f1")
    assert got == [(1, "f1", -0.5), (2, "f1", -1.5)]
    assert compare_conditions(df, keys=["seed"]).count() == 5


def test_quantile_names_are_exact():
    assert [percent_name(p) for p in (0.29, 0.5, 0.505, 0.25, 1.0)] == ["p29", "p50", "p50_5", "p25", "p100"]


@pytest.mark.parametrize("limit", [100, 0])
def test_neighbours_with_text_ids_and_holes(spark, limit):
    trusted = spark.createDataFrame([("a", [0.0, 0.0], 0), ("b", [0.0, 1.0], 0), ("c", [5.0, 5.0], 1)], "row_id string, features array<double>, label bigint")
    cand = spark.createDataFrame([("x", [0.0, 0.1], 0), ("y", None, 0), ("z", [NAN, 1.0], 1)], "row_id string, features array<double>, label bigint")
    got = {r["row_id"]: (r["agree"], r["n_neighbours"]) for r in knn_consistency(cand, trusted, 2, limit=limit).collect()}
    assert got == {"x": (2, 2), "y": (0, 0), "z": (0, 0)}
