"""Experiment drivers: the task-by-task update and the whole run from one parameter row.

The loops run over tasks and conditions, a handful each; every step is a Spark job.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.functions.sizing import small_side
from siltmark.operators.admission import Defence, admit
from siltmark.operators.classifier import PrototypeClassifier, fit_many
from siltmark.operators.corruption import conditions
from siltmark.operators.evaluate import compare_conditions, confusion, metrics_of, novelty_metrics, per_class, to_long
from siltmark.operators.novelty import UNKNOWN, detect_unknown, label_unknown
from siltmark.operators.split import split
from siltmark.operators.tasks import REPLAY_CAP, STRATEGIES, make_tasks, merge_buffer, replay_buffer, task_classes_df, task_manifest, training_set
from siltmark.sources.tables import write_conditions, write_manifest

MATRIX = "strategy string, after_task int, eval_task int, score double, n_rows bigint"
CLASS_METRICS = ["accuracy", "coverage", "macro_precision", "macro_recall", "macro_f1"]
NOVELTY_METRICS = ["tpr", "fpr", "precision", "f1"]


def run_tasks(
    tasked: DataFrame,
    tasks: list[int],
    strategy: str,
    make_model=PrototypeClassifier,
    cap: int = REPLAY_CAP,
    seed: int = 0,
    label: str = "label",
    validate: bool = False,
) -> DataFrame:
    """Accuracy matrix: after each task, the score on the test rows of every task so far.

    With ``validate`` the validation rows of the tasks so far decide when a fit stops
    (``MLClassifier``).

    A model that can continue (``MLClassifier`` perceptrons, given all class ids) goes on from the
    weights of the task before, under both strategies: ``finetune`` on the rows of the task alone,
    ``replay`` with the buffer. Prototypes have nothing to continue and are refitted, so under
    ``finetune`` older classes are gone by construction.
    """
    spark = tasked.sparkSession
    train, val, test = (tasked.where(F.col("split") == s) for s in ("train", "val", "test"))
    cells, model = [], None
    for i, task in enumerate(tasks):
        rows = training_set(train, task, strategy, cap, seed, label=label)
        extra = {"val": val.where(F.col("task_id").isin(tasks[: i + 1]))} if validate else {}
        model = model.update(rows, **extra) if getattr(model, "continues", False) else make_model().fit(rows, **extra)
        seen = test.where(F.col("task_id").isin(tasks[: i + 1]))
        hit = (F.col("pred") == F.col(label)).cast("double")
        scores = model.predict(seen).groupBy("task_id").agg(F.avg(hit).alias("score"), F.count("*").alias("n"))
        cells += [(strategy, int(task), int(r["task_id"]), float(r["score"]), int(r["n"])) for r in scores.collect()]
    return spark.createDataFrame(cells, MATRIX)


def run_both(
    tasked: DataFrame, tasks: list[int], tau: float = 1.0, cap: int = REPLAY_CAP, seed: int = 0, features="features", label: str = "label"
) -> DataFrame:
    """``run_tasks`` for prototypes under both strategies, in four scans for any number of tasks.

    Class sums are additive and tasks share no class: the sums of every task's own rows and
    of its buffered rows are enough to put together each model, and one scan of the test
    rows scores them all.
    """
    train, test = tasked.where(F.col("split") == "train"), tasked.where(F.col("split") == "test")
    current = fit_many(train, "task_id", features, label, tau)
    past = fit_many(replay_buffer(train, cap, seed, label=label), "task_id", features, label, tau)
    scored, cells = test, []
    for i, (strategy, task) in enumerate((s, t) for s in STRATEGIES for t in tasks):
        model = current[task]
        for earlier in tasks[: tasks.index(task)] if strategy == "replay" else []:
            model = model.merge(past[earlier])
        scored = model.predict(scored).withColumnRenamed("pred", f"_pred_{i}").drop("d2", "probs", "max_prob", "pred_d2")
        hit = (F.col(f"_pred_{i}") == F.col(label)).cast("double")
        cells.append(F.struct(F.lit(strategy).alias("strategy"), F.lit(int(task)).alias("after_task"), hit.alias("hit")))
    order = F.array(*[F.lit(int(t)) for t in tasks])
    seen = F.array_position(order, F.col("task_id")) <= F.array_position(order, F.col("after_task"))
    return small_side(
        scored.select("task_id", F.inline(F.array(*cells)))
        .where(seen)
        .groupBy("strategy", "after_task", F.col("task_id").alias("eval_task"))
        .agg(F.avg("hit").alias("score"), F.count("*").alias("n_rows"))
    )


def run_buffers(
    rows: DataFrame, tasks: list[int], path: str, cap: int = REPLAY_CAP, seed: int = 0, defence: Defence | None = None, row_id: str = "row_id", label: str = "label"
) -> DataFrame:
    """The replay buffer after every task: ``rows`` (with ``task_id``) of a task meet the version
    before, so at most 2 * cap rows per class are handled at each step. With ``defence`` only
    admitted rows may enter. Versions are written as they arise (``buffer_version``: the task) and
    overwritten by a repeat; old ones stay, so that what entered can be followed."""
    spark, version = rows.sparkSession, None
    for task in tasks:
        new = rows.where(F.col("task_id") == task)
        if defence is not None:
            new = admit(new, defence).where("decision = 'admit'").select(*rows.columns)
        merged = replay_buffer(new, cap, seed, row_id, label) if version is None else merge_buffer(version, new, cap, seed, row_id, label)
        # Only the selected rows, at most cap per class, meet in the one file of a version.
        merged.repartition(1).write.mode("overwrite").parquet(f"{path}/buffer_version={int(task)}")
        version = spark.read.schema(rows.schema).parquet(f"{path}/buffer_version={int(task)}")
    return spark.read.parquet(path)


@dataclass
class Params:
    """One row of an experiment grid."""

    experiment: str
    dataset: str
    seed: int = 0
    tasks: dict[int, list[int]] = field(default_factory=dict)
    rates: list = field(default_factory=lambda: [0, 0.05])
    threshold: float = 0.5
    tau: float = 1.0
    replay_cap: int = REPLAY_CAP
    commit: str = "not recorded"
    output: str | None = None


def run_conditions(rows: DataFrame, p: Params, features="features", label: str = "label") -> DataFrame:
    """Long metrics per flip rate: fit on each condition's labels, score the clean test rows.

    Novel rows are test rows of classes in no task. All rates share one pair of selection
    scans, one fitting scan and one scoring scan.
    """
    spark = rows.sparkSession
    sided = split(rows, p.seed)
    tasked, holdout = make_tasks(sided, task_classes_df(spark, p.tasks), label)
    train = tasked.where(F.col("split") == "train")
    test = tasked.where(F.col("split") == "test").drop("task_id").withColumn("is_novel", F.lit(False))
    test = test.unionByName(holdout.where(F.col("split") == "test").withColumn("is_novel", F.lit(True)))
    spread = conditions(train, p.rates, p.seed, label=label)
    models = fit_many(spread, "rate", features, "label_poisoned", p.tau)
    return metric_rows(judge_all(test, models, p.threshold, label))


def judge_all(test: DataFrame, models: dict, threshold: float, label: str = "label") -> DataFrame:
    """Counts ``rate, is_novel, y, yhat, n`` of every model on the same rows, in one scan:
    each row is scored by each model and counted at once."""
    scored, cells = test, []
    for i, (rate, model) in enumerate(sorted(models.items())):
        judged = label_unknown(detect_unknown(model.predict(scored), threshold))
        scored = judged.withColumnRenamed("final_pred", f"_pred_{i}").drop("d2", "probs", "max_prob", "pred", "pred_d2", "is_unknown")
        cells.append(F.struct(F.lit(rate).cast("decimal(10,6)").alias("rate"), F.col(f"_pred_{i}").alias("yhat")))
    long = scored.select("is_novel", F.col(label).alias("y"), F.inline(F.array(*cells)))
    return small_side(long.groupBy("rate", "is_novel", "y", "yhat").agg(F.count("*").alias("n")))


def metric_rows(counts: DataFrame) -> DataFrame:
    """``rate, metric, value``: classification on known rows, novelty on all rows."""
    cls = metrics_of(counts.where(~F.col("is_novel")), ["rate"])
    flagged = counts.withColumn("is_unknown", F.col("yhat") == F.lit(UNKNOWN))
    nov = to_long(novelty_metrics(flagged, by=["rate"], weight="n"), ["rate"], NOVELTY_METRICS)
    nov = nov.withColumn("metric", F.concat(F.lit("novelty_"), "metric"))
    return to_long(cls, ["rate"], CLASS_METRICS).unionByName(nov)


def run(rows: DataFrame, p: Params, features="features", label: str = "label") -> dict[str, DataFrame]:
    """The whole experiment: tasks, both strategies, conditions, comparison and manifest.

    Returns the result tables; with ``p.output`` they are also written there, clean and
    corrupted training rows apart.
    """
    spark = rows.sparkSession
    sided = split(rows, p.seed)
    tasked, _ = make_tasks(sided, task_classes_df(spark, p.tasks), label)
    matrix = run_both(tasked, sorted(p.tasks), p.tau, p.replay_cap, p.seed, features, label)
    metrics = run_conditions(rows, p, features, label)
    model = PrototypeClassifier(features, label, p.tau).fit(tasked.where(F.col("split") == "train"))
    cm = confusion(model.predict(tasked.where(F.col("split") == "test")), label)
    tables = {
        "task_manifest": task_manifest(tasked, p.seed, label),
        "task_matrix": matrix,
        "metrics": metrics,
        "comparison": compare_conditions(metrics),
        "confusion": cm,
        "per_class": per_class(cm),
    }
    if p.output:
        for name, table in tables.items():
            table.write.mode("errorifexists").parquet(f"{p.output}/{name}")
        train = tasked.where(F.col("split") == "train")
        write_conditions(conditions(train, p.rates, p.seed, label=label), f"{p.output}/conditions")
        tables = {name: spark.read.parquet(f"{p.output}/{name}") for name in tables}
        tables["manifest"] = write_manifest(spark, manifest_fields(p), f"{p.output}/manifest")
    return tables


def manifest_fields(p: Params) -> dict:
    return {
        "experiment": p.experiment,
        "commit": p.commit,
        "dataset": p.dataset,
        "split": "train 0.70, val 0.10, test 0.20 by seeded row id",
        "class_map": {str(t): c for t, c in p.tasks.items()},
        "seeds": [p.seed],
        "model": "nearest prototype",
        "hyperparameters": {"tau": p.tau, "replay_cap": p.replay_cap},
        "poisoning": {"method": "label_flip", "rates": [str(r) for r in p.rates]},
        "novelty": {"method": "max probability below threshold", "threshold": p.threshold},
        "metrics_location": p.output or "returned, not written",
        "limitations": "finetune refits prototypes on the current task only",
    }
