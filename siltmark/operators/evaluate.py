"""Metric tables. Every input is reduced to counts first; ratios run on the small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.operators.novelty import UNKNOWN


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as a double, 0 where the denominator is 0."""
    n, d = (F.col(c) if isinstance(c, str) else c for c in (num, den))
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, y: str = "label", yhat: str = "pred", by: list[str] | None = None) -> DataFrame:
    """Long confusion counts: ``by..., y, yhat, n``."""
    return df.groupBy(*(by or []), F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count("*").alias("n"))


def confusion_wide(cm: DataFrame, class_ids: list[int]) -> DataFrame:
    """One row per true class, one column per predicted class and one for unknown."""
    cells = {f"pred_{c}": c for c in class_ids} | {"pred_unknown": UNKNOWN}
    return cm.groupBy("y").agg(
        *[F.coalesce(F.sum(F.when(F.col("yhat") == c, F.col("n"))), F.lit(0)).alias(name) for name, c in cells.items()]
    )


def per_class(cm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``class_id, tp, support, predicted, precision, recall, f1`` per class in y or yhat.

    Unknown is a prediction, not a class: it lowers recall and has no row.
    """
    return _class_scores(cm, by or []).where(F.col("class_id").isNotNull())


def _class_scores(cm: DataFrame, by: list[str]) -> DataFrame:
    """Row and column sums of the confusion table from one regrouping, with their ratios.
    Rows without a label or a prediction are kept under a NULL class."""
    sides = F.explode(
        F.array(
            F.struct(F.col("y").alias("class_id"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
            F.struct(F.col("yhat").alias("class_id"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
        )
    )
    zero = F.lit(0).cast("bigint")
    hit = F.when((F.col("y") == F.col("yhat")) & (F.col("_s.support") > 0), F.col("n")).otherwise(zero)
    sums = (
        cm.withColumn("_s", sides)
        .where(~F.col("_s.class_id").eqNullSafe(F.lit(UNKNOWN)))
        .groupBy(*by, F.col("_s.class_id").alias("class_id"))
        .agg(F.sum(hit).alias("tp"), F.sum("_s.support").alias("support"), F.sum("_s.predicted").alias("predicted"))
    )
    scored = sums.withColumns({"precision": ratio("tp", "predicted"), "recall": ratio("tp", "support")})
    return scored.withColumn("f1", ratio(F.lit(2.0) * F.col("tp"), F.col("support") + F.col("predicted")))


def classification_metrics(df: DataFrame, y: str = "label", yhat: str = "pred", by: list[str] | None = None) -> DataFrame:
    """``by..., accuracy, accuracy_covered, coverage, macro_precision, macro_recall, macro_f1,
    n_rows``. Macro averages run over the classes present in y or yhat, unknown excluded."""
    return metrics_of(confusion(df, y, yhat, by), by)


def metrics_of(cm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The same from a confusion table: one aggregate over its per-class sums, no join."""
    by = by or []
    named = F.col("class_id").isNotNull()
    macro = lambda c: F.coalesce(F.avg(F.when(named, F.col(c))), F.lit(0.0)).alias(f"macro_{c}")
    sums = _class_scores(cm, by).groupBy(*by).agg(
        F.coalesce(F.sum("support"), F.lit(0)).alias("n_rows"),
        F.sum(F.when(named, F.col("predicted"))).alias("_known"),
        F.sum("tp").alias("_hit"),
        macro("precision"),
        macro("recall"),
        macro("f1"),
    )
    return sums.select(
        *by,
        ratio("_hit", "n_rows").alias("accuracy"),
        ratio("_hit", "_known").alias("accuracy_covered"),
        ratio("_known", "n_rows").alias("coverage"),
        "macro_precision",
        "macro_recall",
        "macro_f1",
        "n_rows",
    )


def continual_metrics(matrix: DataFrame, strategy: str = "strategy") -> DataFrame:
    """Two-task report: task 1 before and after task 2, task 2, forgetting = before - after."""
    cell = lambda after, task: F.max(F.when((F.col("after_task") == after) & (F.col("eval_task") == task), F.col("score")))
    out = matrix.groupBy(strategy).agg(
        cell(1, 1).alias("task1_before"), cell(2, 1).alias("task1_after"), cell(2, 2).alias("task2_score")
    )
    return out.withColumn("forgetting", F.col("task1_before") - F.col("task1_after"))


def forgetting(matrix: DataFrame, strategy: str = "strategy") -> DataFrame:
    """Per strategy after the last task T: mean over tasks j < T of (best earlier score on j
    minus score now), mean score on old tasks, and the score on task T."""
    best = Window.partitionBy(strategy, "eval_task").orderBy("after_task").rowsBetween(Window.unboundedPreceding, -1)
    scored = matrix.where(F.col("eval_task") <= F.col("after_task")).withColumn("_best", F.max("score").over(best))
    last = Window.partitionBy(strategy)
    final = scored.withColumn("_t", F.max("after_task").over(last)).where(F.col("after_task") == F.col("_t"))
    old = F.col("eval_task") < F.col("_t")
    return final.groupBy(strategy).agg(
        F.max("_t").alias("n_tasks"),
        F.coalesce(F.avg(F.when(old, F.col("_best") - F.col("score"))), F.lit(0.0)).alias("average_forgetting"),
        F.coalesce(F.avg(F.when(old, F.col("score"))), F.lit(0.0)).alias("old_class_retention"),
        F.max(F.when(~old, F.col("score"))).alias("new_class_score"),
    )


def novelty_metrics(
    df: DataFrame, truth: str = "is_novel", flag: str = "is_unknown", by: list[str] | None = None, weight: str | None = None
) -> DataFrame:
    """``tp, fp, fn, tn, tpr, fpr, precision, f1`` of a boolean detector. ``weight`` names a
    count column when the input is already grouped."""
    t, p = F.col(truth), F.col(flag)
    one = F.col(weight) if weight else F.lit(1).cast("bigint")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, one)), F.lit(0).cast("bigint"))
    counts = df.groupBy(*(by or [])).agg(
        total(t & p).alias("tp"), total(~t & p).alias("fp"), total(t & ~p).alias("fn"), total(~t & ~p).alias("tn")
    )
    return counts.withColumns(
        {
            "tpr": ratio("tp", F.col("tp") + F.col("fn")),
            "fpr": ratio("fp", F.col("fp") + F.col("tn")),
            "precision": ratio("tp", F.col("tp") + F.col("fp")),
            "f1": ratio(F.lit(2) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn")),
        }
    )


def new_class_metrics(decisions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Treatment of clean rows of new classes: quarantine and rejection rate, and the share
    of quarantined ones that was later released (the eventual learning rate)."""
    fresh = decisions.where(F.col("is_new_class") & ~F.col("is_poisoned"))
    is_ = lambda d: F.col("decision") == d
    counts = fresh.groupBy(*(by or [])).agg(
        F.count("*").alias("n_rows"),
        F.count_if(is_("quarantine")).alias("quarantined"),
        F.count_if(is_("reject")).alias("rejected"),
        F.count_if(is_("quarantine") & F.col("released_task").isNotNull()).alias("released"),
    )
    return counts.withColumns(
        {
            "quarantine_rate": ratio("quarantined", "n_rows"),
            "rejection_rate": ratio("rejected", "n_rows"),
            "eventual_learning_rate": ratio("released", "quarantined"),
        }
    )


def security_metrics(decisions: DataFrame, log: DataFrame | None = None, by: list[str] | None = None, row_id: str = "row_id") -> DataFrame:
    """``poison_admission_rate, clean_rejection_rate, detection_tpr, detection_fpr``.

    A row counts as detected when it is not admitted. ``log`` marks poisoned rows; without
    it ``decisions`` carries ``is_poisoned``.
    """
    rows = decisions
    if log is not None:
        # A row may be logged by several corruptions.
        marked = log.select(F.col("row_id").alias("_id")).distinct().withColumn("_p", F.lit(True))
        rows = decisions.drop("is_poisoned").join(marked, F.col(row_id) == F.col("_id"), "left")
        rows = rows.withColumn("is_poisoned", F.coalesce(F.col("_p"), F.lit(False)))
    bad, admitted, rejected = F.col("is_poisoned"), F.col("decision") == "admit", F.col("decision") == "reject"
    counts = rows.groupBy(*(by or [])).agg(
        F.count_if(bad).alias("n_poisoned"),
        F.count_if(~bad).alias("n_clean"),
        F.count_if(bad & admitted).alias("poison_admitted"),
        F.count_if(~bad & rejected).alias("clean_rejected"),
        F.count_if(~bad & ~admitted).alias("clean_held"),
    )
    return counts.withColumns(
        {
            "poison_admission_rate": ratio("poison_admitted", "n_poisoned"),
            "clean_rejection_rate": ratio("clean_rejected", "n_clean"),
            "detection_tpr": ratio(F.col("n_poisoned") - F.col("poison_admitted"), "n_poisoned"),
            "detection_fpr": ratio("clean_held", "n_clean"),
        }
    )


def attack_success(df: DataFrame, target: int, triggered: str = "is_triggered", y: str = "label", yhat: str = "pred") -> DataFrame:
    """Share of triggered rows of other classes predicted as the target."""
    rows = df.where(F.col(triggered) & (F.col(y) != F.lit(target)))
    counts = rows.agg(F.count("*").alias("n_triggered"), F.count_if(F.col(yhat) == F.lit(target)).alias("n_success"))
    return counts.withColumn("attack_success_rate", ratio("n_success", "n_triggered"))


def to_long(table: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``keys..., metric, value``."""
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    return table.select(*keys, F.inline(F.array(*cells)))


def compare_conditions(metrics: DataFrame, rate: str = "rate", keys: list[str] | None = None) -> DataFrame:
    """``rate, metric, value, clean_value, delta`` against the rate-0 run of each metric with the
    same ``keys`` (a seed, a class). Metrics without a clean run keep a NULL difference."""
    on = [*(keys or []), "metric"]
    clean = metrics.where(F.col(rate) == 0).select(*on, F.col("value").alias("clean_value"))
    return metrics.join(clean, on, "left").withColumn("delta", F.col("value") - F.col("clean_value"))


def across_seeds(metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean and spread of each metric over repeated seeds."""
    return metrics.groupBy(*(keys or []), "metric").agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("spread"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count("*").alias("n_runs"),
    )


def tradeoff(metrics: DataFrame, names: list[str], setting: str = "setting") -> DataFrame:
    """One row per defence setting, one column per metric."""
    return metrics.groupBy(setting).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names])


def metrics_json(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., metrics`` with the metric table of each key as one JSON object."""
    packed = F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))))
    return metrics.groupBy(*keys).agg(packed.alias("metrics"))


def efficiency(buffer: DataFrame, model_size: dict[str, int], update_seconds: float | None = None, label: str = "label") -> DataFrame:
    """Replay size, classes held and model size; update time where it was measured."""
    return buffer.agg(
        F.count("*").alias("replay_rows"), F.count_distinct(label).alias("replay_classes")
    ).select(
        "*",
        F.lit(int(model_size["parameters"])).cast("bigint").alias("model_parameters"),
        F.lit(int(model_size["bytes"])).cast("bigint").alias("model_bytes"),
        *([F.lit(float(update_seconds)).alias("update_seconds")] if update_seconds is not None else []),
    )
