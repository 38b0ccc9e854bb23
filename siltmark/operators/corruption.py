"""Controlled corruption: exact, seeded, logged. Original values stay in place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.functions.hashing import hex_to_int, seed_key, uniform
from siltmark.functions.sizing import known_classes
from siltmark.operators.selection import lowest_cuts, lowest_rows, mark_lowest
from siltmark.operators.split import fraction

FLIP_SALT = "flip"
TARGET_SALT = "tgt"
PERTURB_SALT = "perturb"


@dataclass(frozen=True)
class Corruption:
    """``data``: all rows, changed values in new columns. ``log``: one row per changed row.
    ``summary``: one row with the requested and achieved rate."""

    data: DataFrame
    log: DataFrame
    summary: DataFrame


def _quota(rate):
    share = fraction(rate)
    return lambda n: F.floor(F.lit(share) * n)


def _chosen(df, eligible, rates: dict, seed, salt, row_id):
    """``df`` with one boolean per rate: TRUE on the lowest floor(rate * eligible) rows."""
    cuts = lowest_cuts(df.where(eligible), {n: _quota(r) for n, r in rates.items()}, seed, salt, row_id)
    marked = mark_lowest(df, cuts, list(rates), seed, salt, row_id, prefix="_pick_")
    return marked.withColumns({f"_pick_{n}": F.coalesce(eligible, F.lit(False)) & F.col(f"_pick_{n}") for n in rates})


def flip_target(allowed: list, seed: int, row_id: str, label: str) -> Column:
    """A different allowed label, spread evenly: a hash-chosen step round the sorted list."""
    k = len(allowed)
    names = F.array(*[F.lit(a) for a in allowed])
    own = F.array_position(names, F.col(label)) - 1
    step = hex_to_int(seed_key(TARGET_SALT, seed, row_id)) % (k - 1)
    return F.try_element_at(names, ((own + 1 + step) % k + 1).cast("int"))


def _allowed(df: DataFrame, label: str, allowed_classes: list | None) -> list:
    allowed = sorted(set(allowed_classes)) if allowed_classes is not None else known_classes(df, label)
    if len(allowed) < 2:
        raise ValueError("flipping needs at least two allowed classes")
    return allowed


def apply_label_flip(
    df: DataFrame, rate, seed: int, allowed_classes: list | None = None, row_id: str = "row_id", label: str = "label"
) -> Corruption:
    """Flip floor(rate * eligible) labels; eligible rows carry an allowed label.

    ``data`` keeps ``label`` and adds ``label_poisoned`` and ``is_poisoned``.
    """
    allowed = _allowed(df, label, allowed_classes)
    eligible = F.col(label).isin(allowed)
    marked = _chosen(df, eligible, {"r": rate}, seed, FLIP_SALT, row_id).withColumnRenamed("_pick_r", "is_poisoned")
    data = marked.withColumn(
        "label_poisoned", F.when(F.col("is_poisoned"), flip_target(allowed, seed, row_id, label)).otherwise(F.col(label))
    )
    log = data.where("is_poisoned").select(
        F.col(row_id).alias("row_id"),
        F.lit("label_flip").alias("kind"),
        F.col(label).cast("string").alias("original"),
        F.col("label_poisoned").cast("string").alias("changed"),
        F.lit(seed).alias("seed"),
    )
    return Corruption(data, log, summarize(data, rate, seed, eligible))


def summarize(data: DataFrame, rate, seed: int, eligible: Column) -> DataFrame:
    """``requested, achieved, achieved_all, changed, eligible, total, seed`` in one pass."""
    one = data.agg(
        F.count_if("is_poisoned").alias("changed"), F.count_if(eligible).alias("eligible"), F.count("*").alias("total")
    )
    share = lambda n: F.coalesce(F.try_divide(F.col("changed").cast("decimal(18,0)"), F.col(n).cast("decimal(18,0)")), F.lit(0)).cast("decimal(10,6)")
    return one.select(
        F.lit(fraction(rate)).cast("decimal(10,6)").alias("requested"),
        share("eligible").alias("achieved"),
        share("total").alias("achieved_all"),
        "changed",
        "eligible",
        "total",
        F.lit(seed).alias("seed"),
    )


def conditions(
    df: DataFrame, rates: list, seed: int, allowed_classes: list | None = None, row_id: str = "row_id", label: str = "label"
) -> DataFrame:
    """The table once per rate: ``rate, condition, label_poisoned, is_poisoned`` added.

    One pair of scans fixes all cuts. A smaller rate flips a subset of a larger one's rows,
    to the same targets. Rate 0 is the clean condition.
    """
    allowed = _allowed(df, label, allowed_classes)
    shares = [fraction(r) for r in rates]
    names = {f"c{i}": s for i, s in enumerate(shares)}
    marked = _chosen(df, F.col(label).isin(allowed), names, seed, FLIP_SALT, row_id)
    target = flip_target(allowed, seed, row_id, label)
    cells = [
        F.struct(
            F.lit(s).cast("decimal(10,6)").alias("rate"),
            F.lit("clean" if s == 0 else f"flip_{s.normalize():f}").alias("condition"),
            F.when(F.col(f"_pick_{n}"), F.col("_target")).otherwise(F.col(label)).alias("label_poisoned"),
            F.col(f"_pick_{n}").alias("is_poisoned"),
        )
        for n, s in names.items()
    ]
    return marked.withColumn("_target", target).select(*df.columns, F.inline(F.array(*cells)))


def perturb_features(
    df: DataFrame,
    cols: list[str],
    rate,
    scale: float,
    seed: int,
    stds: dict[str, float],
    row_id: str = "row_id",
    bounds: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Shift controllable features of floor(rate * rows) rows by up to ``scale`` training
    deviations either way. ``<col>_poisoned`` holds the result; ``bounds`` clip it."""
    marked = _chosen(df, F.lit(True), {"r": rate}, seed, PERTURB_SALT, row_id).withColumnRenamed("_pick_r", "is_poisoned")
    return _shifted(marked, cols, scale, seed, stds, row_id, bounds)


def perturb_log(
    df: DataFrame,
    cols: list[str],
    rate,
    scale: float,
    seed: int,
    stds: dict[str, float],
    row_id: str = "row_id",
    bounds: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """The change log of ``perturb_features``, from the chosen rows alone: the keys of all rows are
    made once, not once to find the cut and once more to mark it."""
    chosen = lowest_rows(df.select(row_id, *cols), _quota(rate), seed, PERTURB_SALT, row_id).withColumn("is_poisoned", F.lit(True))
    return change_log(_shifted(chosen, cols, scale, seed, stds, row_id, bounds), "perturb", seed, row_id)


def _shifted(marked: DataFrame, cols: list[str], scale: float, seed: int, stds: dict, row_id: str, bounds: dict | None) -> DataFrame:
    out = {}
    for c in cols:
        offset = (uniform(seed_key(f"{PERTURB_SALT}:{c}", seed, row_id)) * 2.0 - 1.0) * F.lit(float(scale) * float(stds[c]))
        moved = F.col(c).cast("double") + offset
        if bounds and c in bounds:
            moved = F.greatest(F.lit(float(bounds[c][0])), F.least(F.lit(float(bounds[c][1])), moved))
        out[f"{c}_poisoned"] = F.when(F.col("is_poisoned"), moved).otherwise(F.col(c).cast("double"))
    return marked.withColumns(out)


def apply_trigger(
    df: DataFrame,
    trigger: dict[str, float],
    target,
    rate,
    seed: int,
    row_id: str = "row_id",
    label: str = "label",
    time_range: tuple[str, str, str] | None = None,
) -> DataFrame:
    """Backdoor: set trigger features and the target label on floor(rate * eligible) rows.
    Eligible rows do not carry the target and lie in ``time_range`` = (column, from, to)."""
    eligible = F.col(label) != F.lit(target)
    if time_range:
        column, start, end = time_range
        kind = df.schema[column].dataType
        eligible = eligible & F.col(column).between(F.lit(start).cast(kind), F.lit(end).cast(kind))
    marked = _chosen(df, eligible, {"r": rate}, seed, "trigger", row_id).withColumnRenamed("_pick_r", "is_poisoned")
    changed = {f"{c}_poisoned": F.when(F.col("is_poisoned"), F.lit(v)).otherwise(F.col(c)) for c, v in trigger.items()}
    changed["label_poisoned"] = F.when(F.col("is_poisoned"), F.lit(target)).otherwise(F.col(label))
    return marked.withColumns(changed)


def change_log(data: DataFrame, kind: str, seed: int, row_id: str = "row_id") -> DataFrame:
    """``row_id, kind, field, original, changed, seed`` of every field that a corruption changed:
    what each ``<field>_poisoned`` column of a marked table holds against ``<field>``."""
    fields = [c.removesuffix("_poisoned") for c in data.columns if c.endswith("_poisoned") and c != "is_poisoned"]
    cells = [
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("original"), F.col(f"{f}_poisoned").cast("string").alias("changed"))
        for f in fields
        if f in data.columns
    ]
    found = data.where("is_poisoned").select(F.col(row_id).alias("row_id"), F.inline(F.array(*cells)))
    found = found.where(~F.col("original").eqNullSafe(F.col("changed")))
    return found.select("row_id", F.lit(kind).alias("kind"), "field", "original", "changed", F.lit(seed).alias("seed"))
