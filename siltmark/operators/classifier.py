"""Nearest-prototype classifier behind the fit / predict / predict_proba contract."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.functions.sizing import MAX_CLASSES, bounded_rows
from siltmark.functions.vectors import partial_sums, squared_distances

MAX_MODEL_VALUES = 5_000_000


@dataclass
class PrototypeClassifier:
    """One mean vector per class. State is (count, sum, sum of squares), hence additive:
    models fitted on disjoint rows merge into the model of all of them."""

    features: str | list[str] = "features"
    label: str = "label"
    tau: float = 1.0
    version: int = 1
    stats: dict[int, tuple[int, list[float], list[float]]] = field(default_factory=dict)
    trace: list[tuple[int, str, float]] = field(default_factory=list)

    @property
    def class_ids(self) -> list[int]:
        return sorted(self.stats)

    @property
    def centres(self) -> list[list[float]]:
        return [[s / self.stats[c][0] for s in self.stats[c][1]] for c in self.class_ids]

    def fit(self, train: DataFrame, val: DataFrame | None = None, replay: DataFrame | None = None) -> PrototypeClassifier:
        """Class sums combine in each task before one small shuffle keyed by class and
        position, so a class holding most rows costs no more than the others."""
        rows = train if replay is None else train.unionByName(replay, allowMissingColumns=True)
        self.stats = _class_sums(rows.where(F.col(self.label).isNotNull()), self.features, self.label)
        self.trace = [(self.version, "classes", float(len(self.stats))), (self.version, "rows", float(sum(s[0] for s in self.stats.values())))]
        if val is not None:
            hit = self.predict(val).agg(F.avg((F.col("pred") == F.col(self.label)).cast("double"))).head()[0]
            self.trace.append((self.version, "val_accuracy", float(hit or 0.0)))
        return self

    def merge(self, other: PrototypeClassifier) -> PrototypeClassifier:
        merged = dict(self.stats)
        for c, (n, s, q) in other.stats.items():
            n0, s0, q0 = merged.get(c, (0, [0.0] * len(s), [0.0] * len(q)))
            merged[c] = (n0 + n, [a + b for a, b in zip(s0, s)], [a + b for a, b in zip(q0, q)])
        return PrototypeClassifier(self.features, self.label, self.tau, self.version + 1, merged, [*self.trace, *other.trace])

    def distances(self) -> Column:
        """Squared distance to every prototype, aligned with ``class_ids``."""
        d2 = squared_distances(self.features, self.centres)
        return F.when(F.col(self.features).isNotNull(), d2) if isinstance(self.features, str) else d2

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Add ``d2`` and ``probs`` = softmax(-d2 / tau), both aligned with ``class_ids``."""
        if not self.stats:
            raise ValueError("the model is not fitted")
        # Missing and non-finite vectors have no distances, on every path.
        near = df.withColumn("d2", self.distances())
        finite = F.forall("d2", lambda d: d.isNotNull() & ~F.isnan(d) & (d < float("inf")))
        near = near.withColumn("d2", F.when(finite, F.col("d2")))
        raw = near.withColumn("_e", F.transform("d2", lambda d: F.exp((F.array_min("d2") - d) / F.lit(float(self.tau)))))
        total = F.aggregate("_e", F.lit(0.0), lambda a, e: a + e)
        return raw.withColumn("_t", total).withColumn("probs", F.transform("_e", lambda e: e / F.col("_t"))).drop("_e", "_t")

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``probs``, ``max_prob``, ``pred`` and ``pred_d2``; ties go to the lowest class id.
        All are NULL for a vector that is missing or not finite."""
        scored = self.predict_proba(df).withColumn("max_prob", F.array_max("probs"))
        at = F.array_position(F.col("probs"), F.col("max_prob")).cast("int")
        scored = scored.withColumn("_at", F.when(at > 0, at))
        return scored.withColumns(
            {"pred": F.try_element_at(self.ids_column(), F.col("_at")), "pred_d2": F.try_element_at(F.col("d2"), F.col("_at"))}
        ).drop("_at")

    def ids_column(self) -> Column:
        return F.array(*[F.lit(int(c)) for c in self.class_ids])

    def claimed(self, column: str, label: str | None = None) -> Column:
        """Entry of an aligned array column for the claimed label; NULL for unknown classes."""
        at = F.array_position(self.ids_column(), F.col(label or self.label).cast("int")).cast("int")
        return F.when(at > 0, F.try_element_at(F.col(column), at))

    def to_df(self, spark: SparkSession) -> DataFrame:
        """``class_id, pos, n_rows, total, squares, mean``: the model as a table."""
        rows = [
            (int(c), i, int(n), float(s[i]), float(q[i]), float(s[i] / n))
            for c, (n, s, q) in sorted(self.stats.items())
            for i in range(len(s))
        ]
        return spark.createDataFrame(rows, "class_id int, pos int, n_rows bigint, total double, squares double, mean double")

    def history(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.trace, "iteration int, measure string, value double")

    def size(self) -> dict[str, int]:
        values = sum(len(s) for _, s, _ in self.stats.values())
        return {"parameters": values, "bytes": 8 * values}

    def save(self, spark: SparkSession, path: str) -> None:
        meta = F.lit(float(self.tau)).alias("tau"), F.lit(int(self.version)).alias("version")
        self.to_df(spark).select("*", *meta).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, features: str | list[str] = "features", label: str = "label") -> PrototypeClassifier:
        rows = bounded_rows(spark.read.parquet(path), MAX_MODEL_VALUES, "model values")
        model = cls(features, label, rows[0]["tau"], rows[0]["version"])
        for r in sorted(rows, key=lambda r: (r["class_id"], r["pos"])):
            n, s, q = model.stats.setdefault(r["class_id"], (r["n_rows"], [], []))
            s.append(r["total"])
            q.append(r["squares"])
        return model


def fit_many(
    train: DataFrame, by: str, features: str | list[str] = "features", label: str = "label", tau: float = 1.0
) -> dict[object, PrototypeClassifier]:
    """One model per value of ``by`` (a condition, a seed), all fitted in a single scan."""
    rows = train.where(F.col(label).isNotNull())
    models: dict[object, PrototypeClassifier] = {}
    for (key, c), s in _sums(rows, features, label, by).items():
        models.setdefault(key, PrototypeClassifier(features, label, tau)).stats[c] = s
    return models


def finite_features(features: str | list[str]) -> Column:
    """TRUE for rows whose features are all there and finite: the rows a fit may use."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    if isinstance(features, str):
        return F.coalesce(F.forall(features, sound), F.lit(False))
    return reduce(and_, [sound(F.col(c)) for c in features])


def _class_sums(df: DataFrame, features: str | list[str], label: str) -> dict:
    return {c: s for (_, c), s in _sums(df, features, label, None).items()}


def _sums(df: DataFrame, features: str | list[str], label: str, by: str | None) -> dict:
    """(count, sums, sums of squares) per (``by`` value, class)."""
    keys = ([by] if by else []) + [label]
    name = lambda r: (r[by] if by else None, r[label])
    stats: dict[tuple, tuple[int, list[float], list[float]]] = {}
    df = df.where(finite_features(features))
    if isinstance(features, str):
        # Positions fan out after the sums of each task, not in front of them.
        parts = partial_sums(df, features, keys).select(*keys, "n", F.posexplode(F.arrays_zip("s", "q")).alias("pos", "x"))
        sums = parts.groupBy(*keys, "pos").agg(F.sum("n").alias("n"), F.sum("x.s").alias("s"), F.sum("x.q").alias("q"))
        rows = bounded_rows(sums, MAX_MODEL_VALUES, "model values")
        for r in sorted(rows, key=lambda r: r["pos"]):
            n, s, q = stats.setdefault(name(r), (r["n"], [], []))
            s.append(r["s"])
            q.append(r["q"])
        return stats
    cols = [F.col(c).cast("double") for c in features]
    sums = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(c) for c in cols]).alias("s"),
        F.array(*[F.sum(c * c) for c in cols]).alias("q"),
    )
    for r in bounded_rows(sums, MAX_CLASSES, "classes"):
        stats[name(r)] = (r["n"], list(r["s"]), list(r["q"]))
    return stats
