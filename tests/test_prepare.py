import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.operators.prepare import LabelMap, Scaler, align, assemble, clean, encode_labels, fit_medians
from siltmark.operators.validate import Rule, audit_classes, audit_features, audit_rollup, rules_for, validate, violations
from siltmark.sources import flows as flow_source
from siltmark.sources.flows import read_flows, trim_headers, with_row_id

INF, NAN = float("inf"), float("nan")


@pytest.fixture()
def rows(spark):
    data = [(1, 1.0, 10.0, "a"), (2, INF, 20.0, "b"), (3, 3.0, NAN, "a"), (4, None, 40.0, "zzz"), (5, 9.0, 50.0, None)]
    return spark.createDataFrame(data, "row_id bigint, x double, y double, label string")


def test_validation_counts_and_rows(rows):
    schema = T._parse_datatype_string("row_id bigint, x double, y double, label string, port int")
    rules = rules_for(schema, ["x", "y"], "label", ["a", "b"])
    counts = {(r["kind"], r["column"]): r["violations"] for r in validate(rows, rules).collect()}
    assert counts["missing", "port"] == 5 and counts["missing", "x"] == 0
    assert counts["null", "x"] == 1 and counts["null", "label"] == 1
    assert counts["non_finite", "x"] == 1 and counts["non_finite", "y"] == 1
    assert counts["unknown_label", "label"] == 1
    found = {(r["row_id"], r["kind"], r["column"]) for r in violations(rows, rules).collect()}
    assert found == {(2, "non_finite", "x"), (3, "non_finite", "y"), (4, "null", "x"), (4, "unknown_label", "label"), (5, "null", "label")}


def test_wrong_type_is_a_violation(rows):
    assert validate(rows, [Rule("type", "x", "int")]).head()["violations"] == 5


def test_audit(rows):
    shares = {r["label"]: r["share"] for r in audit_classes(rows).collect()}
    assert shares["a"] == 0.4 and sum(shares.values()) == pytest.approx(1.0)
    x = {r["feature"]: r for r in audit_features(rows, ["x", "y"]).collect()}["x"]
    assert (x["n_null"], x["n_non_finite"], x["n_finite"], x["min"], x["max"], x["p50"]) == (1, 1, 3, 1.0, 9.0, 3.0)
    total = [r for r in audit_rollup(rows.withColumn("split", F.lit("train"))).collect() if r["level"] == 3]
    assert [r["n_rows"] for r in total] == [5]


def test_clean_imputes_with_training_medians(rows):
    med = fit_medians(rows, ["x", "y"])
    assert med == {"x": 3.0, "y": 30.0}
    good, bad = clean(rows, ["x", "y"], "impute", med)
    got = {r["row_id"]: (r["x"], r["y"]) for r in good.collect()}
    assert got[2] == (3.0, 20.0) and got[3] == (3.0, 30.0) and got[4] == (3.0, 40.0) and bad.count() == 0
    good, bad = clean(rows, ["x", "y"], "reject")
    assert {r["row_id"] for r in bad.collect()} == {2, 3, 4} and good.count() == 2


def test_test_rows_do_not_touch_the_scaler(skewed):
    train = skewed.where(F.col("row_id") < 500)
    test = skewed.where(F.col("row_id") >= 500)
    before = Scaler.fit(train, "features")
    changed = train.unionByName(test.withColumn("features", F.transform("features", lambda x: x * 100)))
    assert before == Scaler.fit(changed.where(F.col("row_id") < 500), "features")


def test_scaling_arrays_and_columns_agree_and_constants_become_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double")
    s = Scaler.fit(df, ["x", "y"])
    assert [tuple(r) for r in s.apply(df).collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    packed = assemble(df, ["x", "y"])
    a = Scaler.fit(packed, "features")
    assert [r["features"] for r in a.apply(packed).select("features").collect()] == [[-1.0, 0.0], [1.0, 0.0]]
    assert packed.schema["features"].metadata["feature_names"] == ["x", "y"]


def test_labels_encode_in_name_order(rows):
    coded, m = encode_labels(rows)
    assert m.names == ("a", "b", "zzz")
    assert {r["label"]: r["class_id"] for r in coded.collect()} == {"a": 0, "b": 1, "zzz": 2, None: None}
    unseen = rows.sparkSession.createDataFrame([("q",)], "label string")
    assert encode_labels(unseen, m)[0].head()["class_id"] is None
    assert m.decode(F.lit(1)) is not None and LabelMap.fit(rows) == m


def test_align_adds_missing_features_as_null(rows):
    out = align(rows, {"amount": "x"}, ["amount", "bytes"], "second").first()
    assert out["amount"] == 1.0 and out["bytes"] is None and out["dataset"] == "second"


def test_csv_scan_sets_bad_lines_aside(spark, folder):
    path = folder + "/flows.csv"
    with open(path, "w") as f:
        f.write(" row_id , f0 ,label \n1,1.5,a\n2, Infinity ,b\n3,NaN,a\n4,,b\n5,abc,a\n")
    schema = T._parse_datatype_string("row_id bigint, f0 double, label string")
    good, bad = read_flows(spark, path, schema)
    got = {r["row_id"]: r["f0"] for r in good.collect()}
    assert got[1] == 1.5 and got[2] == INF and math.isnan(got[3]) and got[4] is None and set(got) == {1, 2, 3, 4}
    # The same lines are bad whichever columns a query uses.
    assert {r["row_id"] for r in good.select("row_id").collect()} == {1, 2, 3, 4}
    assert [r["_corrupt_record"] for r in bad.collect()] == ["5,abc,a"] and bad.select("row_id").count() == 1
    assert trim_headers(spark.createDataFrame([(1,)], [" a "])).columns == ["a"]


def test_row_ids_number_the_copies_of_a_hot_row(spark, monkeypatch):
    monkeypatch.setattr(flow_source, "COPIES_PER_CHUNK", 10)
    df = spark.range(90).select(F.when(F.col("id") < 35, F.lit(0)).otherwise(F.col("id")).alias("x"), F.lit(None).cast("string").alias("y"))
    out = [r["row_id"] for r in with_row_id(df).collect()]
    assert len(out) == 90 and len(set(out)) == 90
    again = [r["row_id"] for r in with_row_id(df.repartition(7)).collect()]
    assert sorted(out) == sorted(again)
