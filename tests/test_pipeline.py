import pytest
from pyspark.sql import functions as F

from siltmark.operators.admission import Policy
from siltmark.plans import pipeline
from siltmark.plans.pipeline import Setup, run_grid
from siltmark.sources.grid import experiment_grid

SCHEMA = "flow_id bigint, a double, b double, kind string"


@pytest.fixture()
def flows(spark, folder):
    """Two well separated classes in tasks and a third that stays novel; gaps and a broken line."""
    i = F.col("id")
    kind = F.element_at(F.array(*map(F.lit, ["dos", "probe", "scan"])), (i % 3 + 1).cast("int"))
    noise = F.pmod(F.xxhash64("id"), F.lit(100)) / 200.0
    rows = spark.range(900).select(
        i.alias(" flow_id"), F.when(i % 50 != 0, (F.when(i % 3 == 0, 5.0).otherwise(0.0) + noise).cast("string")).alias("a"),
        F.when(i == 7, "broken").otherwise((F.when(i % 3 == 1, 5.0).otherwise(0.0) + noise).cast("string")).alias("b "), kind.alias("kind"),
    )
    rows.write.option("header", True).csv(folder + "/csv")
    return Setup("flows", folder + "/csv", SCHEMA, "flow_id", "kind", ("a", "b"), {1: [0], 2: [1]}, Policy(None, 5.0, None, 1.0))


def grid(spark, folder, rates, thresholds=(0.6,), strategies=("replay",)):
    return experiment_grid(spark, [3], rates, list(thresholds), strategies=strategies, output=folder + "/results")


def built(stages):
    return sorted((r["run_id"], r["stage"]) for r in stages.where("NOT reused").collect())


def test_runs_share_stages_and_defend(spark, folder, flows):
    metrics, stages = run_grid(spark, folder + "/out", flows, grid(spark, folder, ["0", "0.3"]))
    got = {(r["run_id"], r["metric"]): r["value"] for r in metrics.collect()}
    # Cells filled with medians may change sides; whatever was measured is exact.
    assert min(got[0, "accuracy"], got[1, "accuracy"], got[1, "detection_tpr"], got[0, "old_class_retention"]) > 0.95
    assert got[0, "clean_rejection_rate"] < 0.05
    assert {s for r, s in built(stages) if r == 1} == {"corrupted", "decided", "matrix", "metrics"}
    n = {r["stage"]: r["n_rows"] for r in stages.where("run_id = 0").collect()}
    assert n["rows"] == n["prepared"] == 899 and n["bad_lines"] == 1 and n["label_map"] == 3
    manifest = spark.read.json(folder + "/results/run_00001/manifest").head()
    assert manifest["class_map"] == '{"0": "dos", "1": "probe", "2": "scan"}' and '"version": ' in manifest["dataset"]
    written = spark.read.parquet(manifest["metrics_location"])
    assert {r["metric"]: r["value"] for r in written.collect()} == {m: v for (r, m), v in got.items() if r == 1}


def test_a_broken_run_goes_on_where_it_stopped(spark, folder, flows, monkeypatch):
    def fail(run):
        raise RuntimeError("lost")

    real = pipeline.STAGES["decided"]
    monkeypatch.setitem(pipeline.STAGES, "decided", pipeline.Stage(real.layer, real.needs, real.reads, fail))
    with pytest.raises(RuntimeError, match="lost"):
        run_grid(spark, folder + "/out", flows, grid(spark, folder, ["0.1"]))
    monkeypatch.setitem(pipeline.STAGES, "decided", real)
    _, stages = run_grid(spark, folder + "/out", flows, grid(spark, folder, ["0.1"]))
    assert {s for _, s in built(stages)} == {"decided", "matrix", "metrics", "bad_lines", "checks"}
    _, stages = run_grid(spark, folder + "/out", flows, grid(spark, folder, ["0.1"], (0.7,)))
    assert {s for _, s in built(stages)} == {"metrics"}


def test_a_folder_without_a_record_is_overwritten_and_a_changed_source_rebuilds(spark, folder, flows):
    row = grid(spark, folder, ["0"]).head().asDict()
    run = pipeline.Run(spark, folder + "/out", flows, row)
    half = folder + f"/out/interim/rows-{run.fingerprint('rows')}"
    spark.range(3).write.parquet(half)
    assert run.table("rows").count() == 899
    spark.createDataFrame([(9000, 1.0, 1.0, "dos")], SCHEMA).write.mode("append").option("header", True).csv(flows.path)
    again = pipeline.Run(spark, folder + "/out", flows, row)
    assert again.fingerprint("rows") != run.fingerprint("rows") and again.table("rows").count() == 900


def test_unknown_models_are_refused(spark, folder, flows):
    with pytest.raises(ValueError, match="no model"):
        run_grid(spark, folder, flows, experiment_grid(spark, [1], ["0"], [0.5], models=("forest",), output=folder))


def test_runs_of_a_grid_share_the_fitted_defence(spark, folder, flows, monkeypatch):
    fits, fit = [], pipeline.Defence.fit
    monkeypatch.setattr(pipeline.Defence, "fit", lambda *a: fits.append(1) or fit(*a))
    _, stages = run_grid(spark, folder + "/out", flows, grid(spark, folder, ["0", "0.3"]))
    assert [s for _, s in built(stages)].count("decided") == 2 and len(fits) == 1
