"""Unknown detection, threshold sweeps and quarantine. Inputs are never altered."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.functions.quantiles import exact_quantiles
from siltmark.functions.sizing import bounded_rows, small_side
from siltmark.operators.classifier import PrototypeClassifier

UNKNOWN = -1
#: Score bins of a calibration; a power of two, so that bins and thresholds are exact doubles.
SCORE_BINS = 1024


def detect_unknown(df: DataFrame, threshold: float, probs: str = "probs") -> DataFrame:
    """Add ``is_unknown``: the largest probability is strictly below the threshold, or there is
    none (a vector that could not be scored is held, not trusted)."""
    best = F.array_max(probs)
    return df.withColumn("is_unknown", F.coalesce((best < F.lit(float(threshold))) | F.isnan(best), F.lit(True)))


def calibrate(val: DataFrame, rate: float, pred: str = "pred", max_prob: str = "max_prob", bins: int = SCORE_BINS) -> DataFrame:
    """``<pred>, n_rows, threshold`` from known validation rows: per predicted class the largest
    bin edge below which at most the share ``rate`` of its rows lie, so that calling them unknown
    costs no more false alarms than wanted. Only counts per class and bin leave the tasks; rows
    without a score do not count."""
    if not 0.0 <= rate < 1.0:
        raise ValueError("rate must be in [0, 1)")
    scored = val.where(F.col(max_prob).isNotNull() & ~F.isnan(max_prob) & F.col(pred).isNotNull())
    counts = scored.groupBy(pred, F.floor(F.col(max_prob) * bins).alias("_bin")).agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(pred)
    upto = F.sum("_c").over(whole.orderBy("_bin"))
    allowed = F.floor(F.lit(Decimal(str(rate))) * F.col("n_rows"))
    placed = counts.withColumns({"_upto": upto, "n_rows": F.sum("_c").over(whole)})
    # The bin in which the first row beyond the allowed ones lies.
    first = placed.where(F.col("_upto") > allowed).groupBy(pred, "n_rows").agg(F.min("_bin").alias("_bin"))
    return first.select(pred, "n_rows", (F.col("_bin") / F.lit(float(bins))).alias("threshold"))


def detect_unknown_by_class(df: DataFrame, thresholds: DataFrame, default: float, pred: str = "pred", max_prob: str = "max_prob") -> DataFrame:
    """Add ``is_unknown`` by the threshold of the predicted class (``default`` where it has none)."""
    table = small_side(thresholds.select(F.col(pred).alias("_pred"), F.col("threshold").alias("_threshold")))
    joined = df.join(table, F.col(pred) == F.col("_pred"), "left")
    below = F.col(max_prob) < F.coalesce("_threshold", F.lit(float(default)))
    return joined.withColumn("is_unknown", F.coalesce(below | F.isnan(max_prob), F.lit(True))).drop("_pred", "_threshold")


def label_unknown(df: DataFrame, pred: str = "pred") -> DataFrame:
    """Add ``final_pred``: the prediction, or -1 where the row is unknown."""
    return df.withColumn("final_pred", F.when(F.col("is_unknown"), F.lit(UNKNOWN)).otherwise(F.col(pred)))


def threshold_sweep(df: DataFrame, thresholds: list[float], is_novel: str = "is_novel", max_prob: str = "max_prob") -> DataFrame:
    """Confusion counts of "unknown" per threshold: ``threshold, tp, fp, fn, tn``.

    Rows are counted once by how many thresholds they reach, whatever the number of
    thresholds; the counts per threshold are sums over that small table.
    """
    steps = sorted({float(t) for t in thresholds})
    reached = F.lit(0)
    for t in steps:
        reached = reached + F.when(F.col(max_prob) >= F.lit(t), 1).otherwise(0)
    binned = df.groupBy(reached.alias("_reached")).agg(
        F.count_if(F.col(is_novel)).alias("_novel"), F.count_if(~F.col(is_novel)).alias("_known")
    )
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(steps)]))
    below = F.col("_reached") <= F.col("_t.i")
    return (
        binned.withColumn("_t", table)
        .groupBy(F.col("_t.threshold").alias("threshold"))
        .agg(
            F.sum(F.when(below, F.col("_novel")).otherwise(0)).alias("tp"),
            F.sum(F.when(below, F.col("_known")).otherwise(0)).alias("fp"),
            F.sum(F.when(below, 0).otherwise(F.col("_novel"))).alias("fn"),
            F.sum(F.when(below, 0).otherwise(F.col("_known"))).alias("tn"),
        )
    )


def own_distances(rows: DataFrame, model: PrototypeClassifier) -> DataFrame:
    """``label, _d``: distance of every row to the prototype of its own class, NULL where the
    vector has none."""
    own = rows.withColumn("d2", model.distances()).select(model.label, F.sqrt(model.claimed("d2")).alias("_d"))
    return own.withColumn("_d", F.when(~F.isnan("_d") & (F.col("_d") < float("inf")), F.col("_d")))


def distance_quantiles(rows: DataFrame, model: PrototypeClassifier, probs: list[float]) -> dict[float, dict[int, float]]:
    """Per prob and class the quantile of the distance of its rows to its prototype."""
    wanted = sorted(set(probs))
    table = exact_quantiles(own_distances(rows, model), "_d", wanted, [model.label])
    found: dict[float, dict[int, float]] = {p: {} for p in wanted}
    for r in bounded_rows(table, (len(model.class_ids) + 1) * len(wanted), "distance quantiles"):
        found[r["prob"]][r[model.label]] = r["quantile"]
    return found


def class_radii(train: DataFrame, model: PrototypeClassifier, q: float) -> dict[int, float]:
    """Per class the ``q`` quantile of the distance of its training rows to its prototype."""
    return distance_quantiles(train, model, [q])[q]


def detect_far(df: DataFrame, model: PrototypeClassifier, radii: dict[int, float]) -> DataFrame:
    """Add ``nearest_dist``, ``is_far`` (beyond the radius of the nearest class) and
    ``is_far_from_all`` (beyond the radius of every class). ``df`` carries ``d2``. Nothing lies
    inside a class without a radius (no trusted row), and a row without distances is far."""
    r = F.array(*[F.lit(radii.get(c)).cast("double") for c in model.class_ids])
    nearest = F.array_min("d2")
    at = F.array_position(F.col("d2"), nearest).cast("int")
    outside = F.forall(F.zip_with("d2", r, lambda d, r: F.coalesce(F.sqrt(d) > r, F.lit(True))), lambda b: b)
    return df.withColumns(
        {
            "nearest_dist": F.sqrt(nearest),
            "is_far": F.coalesce(F.sqrt(nearest) > F.try_element_at(r, F.when(at > 0, at)), F.lit(True)),
            "is_far_from_all": F.coalesce(outside, F.lit(True)),
        }
    )


def quarantine(df: DataFrame, task: int, decision: str = "decision") -> DataFrame:
    """The rows held back, stamped with the task they arrived in; not yet released."""
    return df.where(F.col(decision) == "quarantine").withColumns(quarantine_marks(task))


def quarantine_marks(task: int) -> dict[str, Column]:
    return {"arrived_task": F.lit(int(task)), "released_task": F.lit(None).cast("int")}


def release(
    held: DataFrame, min_support: int, max_dispersion: float, task: int, claimed: str = "label", distance: str = "nearest_dist"
) -> DataFrame:
    """Quarantined rows of claimed classes with enough support and little spread, stamped
    with the releasing task: these classes become candidates for learning."""
    support = held.groupBy(F.col(claimed).alias("_claimed")).agg(F.count("*").alias("support"), F.avg(distance).alias("dispersion"))
    ready = small_side(support.where((F.col("support") >= min_support) & (F.col("dispersion") <= max_dispersion)))
    return held.join(ready, F.col(claimed) == F.col("_claimed"), "left_semi").withColumn("released_task", F.lit(int(task)))
