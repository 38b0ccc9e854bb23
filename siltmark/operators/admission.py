"""Admission signals and the controller that decides admit, quarantine or reject."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.functions.quantiles import exact_quantiles
from siltmark.functions.sizing import bounded_rows
from siltmark.operators.classifier import PrototypeClassifier
from siltmark.operators.novelty import detect_far, distance_quantiles, own_distances
from siltmark.operators.prepare import Scaler
from siltmark.operators.tasks import REPLAY_CAP, replay_buffer

MAD_SCALE = 1.4826  # makes the median absolute deviation estimate a normal deviation


@dataclass(frozen=True)
class Policy:
    """Thresholds of the controller. ``None`` switches a signal off."""

    min_confidence: float | None = 0.5
    distance_k: float | None = 3.0
    max_anomaly: float | None = None
    radius_quantile: float = 0.99


@dataclass(frozen=True)
class Defence:
    """Everything the controller needs, fitted once on trusted rows."""

    model: PrototypeClassifier
    policy: Policy
    limits: dict[int, float]
    radii: dict[int, float]
    scaler: Scaler | None = None

    @classmethod
    def fit(cls, model: PrototypeClassifier, trusted: DataFrame, policy: Policy) -> Defence:
        found = distance_quantiles(trusted, model, [0.5, policy.radius_quantile])
        radii = found[policy.radius_quantile]
        limits = distance_limits(trusted, model, policy.distance_k, found[0.5]) if policy.distance_k is not None else {}
        scaler = Scaler.fit(trusted, model.features) if policy.max_anomaly is not None else None
        return cls(model, policy, limits, radii, scaler)


def confidence_signal(df: DataFrame, model: PrototypeClassifier) -> DataFrame:
    """Add ``claimed_prob``: probability of the claimed label, NULL for unknown classes."""
    return df.withColumn("claimed_prob", model.claimed("probs"))


def distance_limits(trusted: DataFrame, model: PrototypeClassifier, k: float, medians: dict | None = None) -> dict[int, float]:
    """Per class median + k * 1.4826 * MAD of the distance of trusted rows to their prototype."""
    medians = medians or distance_quantiles(trusted, model, [0.5])[0.5]
    return _limits(medians, deviations(trusted, model, medians), k)


def deviations(trusted: DataFrame, model: PrototypeClassifier, medians: dict[int, float]) -> dict[int, float]:
    """Per class the median absolute deviation of the distance of trusted rows."""
    label = model.label
    off = own_distances(trusted, model).select(label, F.abs(F.col("_d") - per_class_value(medians, F.col(label))).alias("_o"))
    rows = bounded_rows(exact_quantiles(off, "_o", [0.5], [label]), len(model.class_ids) + 1, "deviations")
    return {r[label]: r["quantile"] for r in rows}


def _limits(medians: dict, mads: dict, k: float) -> dict[int, float]:
    return {c: medians[c] + k * MAD_SCALE * mads[c] for c in medians if c in mads}


def per_class_value(values: dict[int, float], label: Column) -> Column:
    """A fitted per-class number as an expression; NULL for classes without one."""
    ids = sorted(values)
    if not ids:
        return F.lit(None).cast("double")
    at = F.array_position(F.array(*[F.lit(int(c)) for c in ids]), label.cast("int")).cast("int")
    return F.when(at > 0, F.try_element_at(F.array(*[F.lit(float(values[c])) for c in ids]), at))


def robust_distance(df: DataFrame, model: PrototypeClassifier, limits: dict[int, float]) -> DataFrame:
    """Add ``claimed_dist``, ``dist_limit`` and ``dist_ok``. ``df`` carries ``d2``."""
    return df.withColumns(
        {"claimed_dist": F.sqrt(model.claimed("d2")), "dist_limit": per_class_value(limits, F.col(model.label))}
    ).withColumn("dist_ok", F.coalesce(F.col("claimed_dist") <= F.col("dist_limit"), F.lit(False)))


def label_consistency(df: DataFrame, model: PrototypeClassifier) -> DataFrame:
    """Add ``label_ok``: the nearest prototype's class is the claimed label."""
    return df.withColumn("label_ok", F.coalesce(F.col("pred") == F.col(model.label), F.lit(False)))


def anomaly_score(df: DataFrame, scaler: Scaler) -> DataFrame:
    """Add ``anomaly``: the largest absolute z-score over the features."""
    if isinstance(scaler.features, str):
        means = F.array(*[F.lit(m) for m in scaler.mean])
        stds = F.array(*[F.lit(s if s else float("inf")) for s in scaler.std])
        off = F.zip_with(scaler.features, means, lambda x, m: F.abs(x.cast("double") - m))
        return df.withColumn("anomaly", F.array_max(F.zip_with(off, stds, lambda x, s: x / s)))
    return df.withColumn("anomaly", F.greatest(*[F.abs(scaler.z(i, F.col(c))) for i, c in enumerate(scaler.features)], F.lit(0.0)))


def signals(df: DataFrame, defence: Defence) -> DataFrame:
    """All signal columns on every candidate: one narrow projection over fitted literals."""
    model = defence.model
    out = model.predict(df)
    out = detect_far(out, model, defence.radii)
    out = label_consistency(confidence_signal(out, model), model)
    if defence.policy.distance_k is not None:
        out = robust_distance(out, model, defence.limits)
    if defence.scaler is not None:
        out = anomaly_score(out, defence.scaler)
    return out


def decide(df: DataFrame, policy: Policy, model: PrototypeClassifier) -> DataFrame:
    """Add ``decision`` and ``reason``. Novelty is settled before any rejection, so that an
    unfamiliar row is held and not dropped; so is a row whose vector cannot be scored."""
    known = F.coalesce(F.col(model.label).isin(model.class_ids), F.lit(False))
    reason = F.when(~known, "unknown_class").when(F.col("d2").isNull(), "invalid_vector").when(F.col("is_far_from_all"), "far").when(~F.col("label_ok"), "label_mismatch")
    if policy.min_confidence is not None:
        reason = reason.when(F.col("claimed_prob") < F.lit(policy.min_confidence), "low_confidence")
    if policy.distance_k is not None:
        reason = reason.when(~F.col("dist_ok"), "distance")
    if policy.max_anomaly is not None:
        reason = reason.when(F.col("anomaly") > F.lit(policy.max_anomaly), "anomaly")
    out = df.withColumn("reason", reason.otherwise("ok"))
    held = F.col("reason").isin("unknown_class", "invalid_vector", "far")
    return out.withColumn("decision", F.when(F.col("reason") == "ok", "admit").when(held, "quarantine").otherwise("reject"))


def admit(df: DataFrame, defence: Defence) -> DataFrame:
    return decide(signals(df, defence), defence.policy, defence.model)


def admit_each(df: DataFrame, model: PrototypeClassifier, trusted: DataFrame, policies: dict[str, Policy]) -> DataFrame:
    """``df``'s columns plus ``setting, decision, reason``: every policy on the same rows.

    The trusted statistics are fitted once for all policies and the candidates are scored in
    one scan; each row is then judged by every policy where it lies.
    """
    wanted = [p.radius_quantile for p in policies.values()]
    found = distance_quantiles(trusted, model, [0.5, *wanted])
    needs_mad = any(p.distance_k is not None for p in policies.values())
    mads = deviations(trusted, model, found[0.5]) if needs_mad else {}
    needs_z = any(p.max_anomaly is not None for p in policies.values())
    scaler = Scaler.fit(trusted, model.features) if needs_z else None
    scored, cells = label_consistency(confidence_signal(model.predict(df), model), model), []
    if scaler is not None:
        scored = anomaly_score(scored, scaler)
    for i, (name, policy) in enumerate(policies.items()):
        judged = detect_far(scored, model, found[policy.radius_quantile])
        if policy.distance_k is not None:
            judged = robust_distance(judged, model, _limits(found[0.5], mads, policy.distance_k))
        judged = decide(judged, policy, model)
        scored = judged.withColumnsRenamed({"decision": f"_d{i}", "reason": f"_r{i}"})
        cells.append(F.struct(F.lit(name).alias("setting"), F.col(f"_d{i}").alias("decision"), F.col(f"_r{i}").alias("reason")))
    return scored.select(*df.columns, F.inline(F.array(*cells)))


def secure_replay(df: DataFrame, defence: Defence, cap: int = REPLAY_CAP, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """Class-balanced buffer built from admitted rows only."""
    admitted = admit(df, defence).where(F.col("decision") == "admit").select(*df.columns)
    return replay_buffer(admitted, cap, seed, row_id, defence.model.label)


def audit_buffer(buffer: DataFrame, defence: Defence, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """``(kept, evicted)``: members the controller would no longer admit are evicted."""
    judged = admit(buffer, defence)
    out = F.col("decision") != "admit"
    return judged.where(~out).select(*buffer.columns), judged.where(out).select(*buffer.columns, "decision", "reason")
