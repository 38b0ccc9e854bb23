"""The whole chain from raw CSV files to metrics, one run per row of an experiment grid.

A run is a graph of stages. The output of a stage is written once under a fingerprint of its
inputs: its name and version, the settings it reads and the fingerprints of the stages it needs
(the source counts by its file listing). Runs that agree on these share the table, so a grid
pays for its preparation once, and a run that broke off goes on at the first missing stage.

A stage counts as done when its record is written, which happens after its rows are: a folder
without a record is the rest of a broken run and is overwritten.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.functions.sizing import MAX_CLASSES, bounded_rows, small_side
from siltmark.operators.admission import Defence, Policy, admit
from siltmark.operators.classifier import PrototypeClassifier
from siltmark.operators.corruption import apply_label_flip
from siltmark.operators.evaluate import confusion, forgetting, metrics_of, novelty_metrics, security_metrics, to_long
from siltmark.operators.novelty import UNKNOWN, detect_unknown, label_unknown
from siltmark.operators.prepare import LabelMap, Scaler, assemble, clean, fit_medians
from siltmark.operators.split import split
from siltmark.operators.tasks import task_classes_df, training_set
from siltmark.operators.validate import rules_for, validate
from siltmark.plans.experiment import CLASS_METRICS, NOVELTY_METRICS, run_tasks
from siltmark.sources.flows import read_flows
from siltmark.sources.tables import layer_path, write_layer, write_manifest

VERSION = 1
MAX_RUNS = 10_000
SECURITY_METRICS = ["poison_admission_rate", "clean_rejection_rate", "detection_tpr", "detection_fpr"]
RETENTION_METRICS = ["average_forgetting", "old_class_retention", "new_class_score"]
RECORD = "stage string, fingerprint string, path string, n_rows bigint, seconds double"
RUNS = "run_id int, stage string, fingerprint string, reused boolean, n_rows bigint, seconds double"


@dataclass(frozen=True)
class Setup:
    """What all runs of a grid share: the source, its columns, tasks and the defence."""

    dataset: str
    path: str
    schema: str
    row_id: str
    label: str
    features: tuple[str, ...]
    tasks: dict[int, list[int]] = field(hash=False)
    policy: Policy = Policy()
    tau: float = 1.0
    commit: str = "not recorded"


@dataclass(frozen=True)
class Stage:
    """``needs`` are earlier stages, ``reads`` the settings that change its rows."""

    layer: str
    needs: tuple[str, ...]
    reads: tuple[str, ...]
    build: Callable[[Run], DataFrame]


class Run:
    """One row of the grid over a root folder: builds or reuses the stages that are asked for."""

    def __init__(self, spark: SparkSession, root: str, setup: Setup, row: dict, fitted: dict[str, Defence] | None = None):
        self.spark, self.root, self.setup = spark, root.rstrip("/"), setup
        self.settings = asdict(setup) | {k: str(v) for k, v in row.items() if k not in ("run_id", "output")}
        self.row = row
        self.source = file_fingerprint(spark, setup.path)
        self.tables: dict[str, DataFrame] = {}
        self.log: list[tuple] = []
        #: Defences by the fingerprint of the rows they were fitted on: the runs of a grid share them.
        self.fitted = {} if fitted is None else fitted

    def fingerprint(self, name: str) -> str:
        stage = STAGES[name]
        inputs = [self.fingerprint(n) for n in stage.needs] or [self.source]
        settings = {s: self.settings[s] for s in stage.reads}
        return hashlib.sha256(json.dumps([name, VERSION, settings, inputs], sort_keys=True).encode()).hexdigest()[:24]

    def table(self, name: str) -> DataFrame:
        """The rows of a stage, built after the stages it needs unless it is there already."""
        if name not in self.tables:
            stage, key = STAGES[name], self.fingerprint(name)
            for n in stage.needs:
                self.table(n)
            record = self.recorded(key)
            start = time.monotonic()
            if record is None:
                path = write_layer(stage.build(self), self.root, stage.layer, f"{name}-{key}", "overwrite")
                n_rows = self.spark.read.parquet(path).count()
                seconds = time.monotonic() - start
                self.spark.createDataFrame([(name, key, path, n_rows, seconds)], RECORD).coalesce(1).write.mode("overwrite").parquet(self.record_path(key))
            else:
                path, n_rows, seconds = record["path"], record["n_rows"], 0.0
            self.tables[name] = self.spark.read.parquet(path)
            self.log.append((self.row["run_id"], name, key, record is not None, n_rows, seconds))
        return self.tables[name]

    def record_path(self, key: str) -> str:
        return layer_path(self.root, "metadata", f"stages/{key}")

    def recorded(self, key: str):
        try:
            return self.spark.read.schema(RECORD).parquet(self.record_path(key)).head()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    # What later stages read back from the small tables.

    def class_map(self) -> LabelMap:
        rows = bounded_rows(self.table("label_map"), MAX_CLASSES, "classes")
        return LabelMap(tuple(r["class_name"] for r in sorted(rows, key=lambda r: r["class_id"])))

    def side(self, name: str, which: str) -> DataFrame:
        return self.table(name).where(F.col("split") == which)

    def arranged(self) -> DataFrame:
        """Admitted training rows under their claimed label, and the clean test rows of all tasks."""
        columns = ["row_id", "features", "label", "task_id", "split"]
        train = self.table("decided").where("decision = 'admit'").select("row_id", "features", F.col("claimed").alias("label"), "task_id", F.lit("train").alias("split"))
        return train.unionByName(self.side("tasked", "test").where("task_id IS NOT NULL").select(*columns))

    def task_ids(self) -> list[int]:
        return sorted(self.setup.tasks)

    def final_model(self) -> PrototypeClassifier:
        train = self.arranged().where("split = 'train'")
        rows = training_set(train, self.task_ids()[-1], self.row["strategy"], self.row["replay_cap"], self.row["seed"])
        return PrototypeClassifier(tau=self.setup.tau).fit(rows)


def file_fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files under a path, in any order; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    row = F.md5(F.concat_ws("|", F.element_at(F.split("path", "/"), -1), "length", F.col("modificationTime").cast("double")))
    bits = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    n, total = files.agg(F.count("*"), F.coalesce(F.sum(bits), F.lit(0))).head()
    return f"{n}:{total}"


def _read(run: Run) -> tuple[DataFrame, DataFrame]:
    return read_flows(run.spark, run.setup.path, T._parse_datatype_string(run.setup.schema), "csv")


def _rows(run: Run) -> DataFrame:
    s = run.setup
    rows, _ = _read(run)
    rows = rows.select(F.col(s.row_id).alias("row_id"), *s.features, F.col(s.label).cast("string").alias("label_name"))
    return split(rows, run.row["seed"])


def _bad_lines(run: Run) -> DataFrame:
    return _read(run)[1].select("_corrupt_record")


def _checks(run: Run) -> DataFrame:
    rows, s = run.table("rows"), run.setup
    names = [str(r[0]) for r in bounded_rows(run.side("rows", "train").select("label_name").where("label_name IS NOT NULL").distinct(), MAX_CLASSES, "classes")]
    return validate(rows, rules_for(rows.select("row_id", *s.features, "label_name").schema, list(s.features), "label_name", sorted(names)))


def _clean(run: Run) -> DataFrame:
    """Gaps filled with training medians; rows without a label cannot be used."""
    features = list(run.setup.features)
    good, _ = clean(run.table("rows").where("label_name IS NOT NULL"), features, "impute", fit_medians(run.side("rows", "train"), features))
    return good


def _label_map(run: Run) -> DataFrame:
    return LabelMap.fit(run.side("clean", "train"), "label_name").to_df(run.spark)


def _prepared(run: Run) -> DataFrame:
    """Class ids and scaled features; both fitted on the training side. A label that the training
    side never showed has no id, and its rows stay out."""
    features = list(run.setup.features)
    scaled = Scaler.fit(run.side("clean", "train"), features).apply(run.table("clean"))
    rows = assemble(scaled, features).withColumn("label", run.class_map().encode(F.col("label_name")))
    return rows.where("label IS NOT NULL").select("row_id", "features", "label", "split")


def _tasked(run: Run) -> DataFrame:
    """All rows; classes in no task keep a NULL task and serve as novel rows."""
    classes = small_side(task_classes_df(run.spark, run.setup.tasks))
    return run.table("prepared").join(classes, F.col("label") == F.col("class_id"), "left").drop("class_id")


def _corrupted(run: Run) -> DataFrame:
    train = run.side("tasked", "train").where("task_id IS NOT NULL")
    allowed = [c for classes in run.setup.tasks.values() for c in classes]
    return apply_label_flip(train, run.row["poison_rate"], run.row["seed"], allowed).data


def _decided(run: Run) -> DataFrame:
    """Decisions of the defence, fitted on clean validation rows, over the claimed labels."""
    s = run.setup
    trusted = run.side("tasked", "val").where("task_id IS NOT NULL")
    key = run.fingerprint("tasked")
    if key not in run.fitted:
        run.fitted[key] = Defence.fit(PrototypeClassifier(tau=s.tau).fit(trusted), trusted, s.policy)
    defence = run.fitted[key]
    claimed = run.table("corrupted").withColumnsRenamed({"label": "truth", "label_poisoned": "label"})
    out = admit(claimed, defence).withColumnRenamed("label", "claimed")
    return out.select("row_id", "features", "truth", "claimed", "is_poisoned", "task_id", "decision", "reason")


def _matrix(run: Run) -> DataFrame:
    make = lambda: PrototypeClassifier(tau=run.setup.tau)
    return run_tasks(run.arranged(), run.task_ids(), run.row["strategy"], make, run.row["replay_cap"], run.row["seed"])


def _metrics(run: Run) -> DataFrame:
    """``metric, value`` of four families: classification, novelty, security, retention."""
    judged = label_unknown(detect_unknown(run.final_model().predict(run.side("tasked", "test")), float(run.row["threshold"])))
    judged = judged.withColumn("is_novel", F.col("task_id").isNull())
    counts = small_side(confusion(judged, "label", "final_pred", ["is_novel"]))
    flagged = counts.withColumn("is_unknown", F.col("yhat").eqNullSafe(F.lit(UNKNOWN)))
    families = [
        ("", metrics_of(counts.where("NOT is_novel").drop("is_novel")), CLASS_METRICS),
        ("novelty_", novelty_metrics(flagged, weight="n"), NOVELTY_METRICS),
        ("", security_metrics(run.table("decided")), SECURITY_METRICS),
        ("", forgetting(run.table("matrix")), RETENTION_METRICS),
    ]
    out = None
    for prefix, table, names in families:
        long = to_long(table, [], names).withColumn("metric", F.concat(F.lit(prefix), "metric"))
        out = long if out is None else out.unionByName(long)
    return out.coalesce(1)


_COLUMNS = ("schema", "row_id", "label", "features")

STAGES = {
    "bad_lines": Stage("interim", (), ("schema",), _bad_lines),
    "rows": Stage("interim", (), (*_COLUMNS, "seed"), _rows),
    "checks": Stage("metadata", ("rows",), ("features",), _checks),
    "clean": Stage("interim", ("rows",), ("features",), _clean),
    "label_map": Stage("metadata", ("clean",), (), _label_map),
    "prepared": Stage("processed", ("clean", "label_map"), ("features",), _prepared),
    "tasked": Stage("processed", ("prepared",), ("tasks",), _tasked),
    "corrupted": Stage("processed", ("tasked",), ("tasks", "poison_rate", "seed"), _corrupted),
    "decided": Stage("processed", ("tasked", "corrupted"), ("policy", "tau"), _decided),
    "matrix": Stage("metadata", ("tasked", "decided"), ("tasks", "model", "strategy", "replay_cap", "seed", "tau"), _matrix),
    "metrics": Stage("metadata", ("tasked", "decided", "matrix"), ("tasks", "model", "strategy", "replay_cap", "seed", "tau", "threshold"), _metrics),
}


def run_manifest(run: Run) -> dict:
    s, row = run.setup, run.row
    return {
        "experiment": f"run {row['run_id']}",
        "commit": s.commit,
        "dataset": {"name": s.dataset, "version": run.source, "schema": s.schema},
        "split": {"rule": "train 0.70, val 0.10, test 0.20 by seeded row id", "prepared": run.fingerprint("prepared")},
        "class_map": dict(enumerate(run.class_map().names)),
        "seeds": [row["seed"]],
        "model": row["model"],
        "hyperparameters": {"tau": s.tau, "strategy": row["strategy"], "replay_cap": row["replay_cap"], "tasks": s.tasks, "policy": asdict(s.policy)},
        "poisoning": {"method": "label_flip", "rate": str(row["poison_rate"])},
        "novelty": {"method": "max probability below threshold", "threshold": row["threshold"]},
        "metrics_location": layer_path(run.root, "metadata", f"metrics-{run.fingerprint('metrics')}"),
        "limitations": "prototypes have nothing to continue: finetune refits them on the last task only",
    }


def run_grid(spark: SparkSession, root: str, setup: Setup, grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(metrics, stages)`` of every row of a grid: ``run_id, metric, value``, and which stage
    each run built or reused. Every run writes a manifest into its ``output`` folder."""
    rows = sorted(bounded_rows(grid, MAX_RUNS, "runs"), key=lambda r: r["run_id"])
    if others := {r["model"] for r in rows} - {"prototype"}:
        raise ValueError(f"no model {sorted(others)}")
    metrics, log, fitted = None, [], {}
    for r in rows:
        run = Run(spark, root, setup, r.asDict(), fitted)
        found = run.table("metrics").select(F.lit(r["run_id"]).alias("run_id"), "metric", "value")
        run.table("bad_lines"), run.table("checks")
        write_manifest(spark, run_manifest(run), f"{r['output']}/manifest", "overwrite")
        metrics = found if metrics is None else metrics.unionByName(found)
        log += run.log
    return metrics, spark.createDataFrame(log, RUNS)
