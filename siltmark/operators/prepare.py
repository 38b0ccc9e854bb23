"""Cleaning, assembly, label encoding and train-only scaling.

Whatever is fitted is a small model of parameters read once from the training rows. Using
it is a projection of literals: no join, no shuffle and no second scan of the training set.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.functions.quantiles import column_quantiles
from siltmark.functions.sizing import bounded_rows, known_classes
from siltmark.functions.vectors import long_values
from siltmark.operators.validate import non_finite

MAX_FEATURES = 100_000


def blank_non_finite(df: DataFrame, features: list[str]) -> DataFrame:
    """NaN and infinities become NULL."""
    return df.withColumns({c: F.when(~non_finite(F.col(c)), F.col(c)) for c in features})


def fit_medians(train: DataFrame, features: list[str]) -> dict[str, float | None]:
    """Exact median of the finite values of every feature."""
    found, _ = column_quantiles(blank_non_finite(train, features).select(*features), features, [0.5])
    return {c: found[c][0.5] for c in features}


def clean(df: DataFrame, features: list[str], policy: str = "impute", medians: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """``(clean, rejects)``. ``impute`` fills gaps with training medians and rejects only rows
    it cannot fill; ``reject`` routes every row with a gap to the rejects."""
    blank = blank_non_finite(df, features)
    if policy == "impute":
        if medians is None:
            raise ValueError("impute needs the medians of the training rows")
        fill = {c: F.coalesce(F.col(c), F.lit(medians[c]).cast("double")) for c in features if medians.get(c) is not None}
        blank = blank.withColumns({c: v.cast(df.schema[c].dataType) for c, v in fill.items()})
    elif policy != "reject":
        raise ValueError(f"unknown policy {policy}")
    gap = F.lit(False)
    for c in features:
        gap = gap | F.col(c).isNull()
    return blank.where(~gap), blank.where(gap)


def assemble(df: DataFrame, feature_names: list[str], output: str = "features") -> DataFrame:
    """One ARRAY<FLOAT> in the given order; the order is recorded in the column metadata."""
    packed = F.array(*[F.col(c).cast("float") for c in feature_names])
    return df.withColumn(output, packed).withMetadata(output, {"feature_names": list(feature_names)})


@dataclass(frozen=True)
class LabelMap:
    """Class ids 0..n-1 in name order; the same names give the same ids everywhere."""

    names: tuple[str, ...]

    @classmethod
    def fit(cls, df: DataFrame, label: str = "label") -> LabelMap:
        return cls(tuple(str(v) for v in known_classes(df, label)))

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.names)), "class_id int, class_name string")

    def encode(self, col: Column) -> Column:
        """NULL for a label that is not in the map."""
        hit = F.array_position(self._array(), col.cast("string"))
        return F.when(hit > 0, (hit - 1).cast("int"))

    def decode(self, col: Column) -> Column:
        return F.try_element_at(self._array(), col.cast("int") + 1)

    def _array(self) -> Column:
        return F.array(*[F.lit(n) for n in self.names])


def encode_labels(df: DataFrame, class_map: LabelMap | None = None, label: str = "label") -> tuple[DataFrame, LabelMap]:
    class_map = class_map or LabelMap.fit(df, label)
    return df.withColumn("class_id", class_map.encode(F.col(label))), class_map


@dataclass(frozen=True)
class Scaler:
    """z-score with the population deviation; a constant feature maps to 0."""

    features: str | tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]

    @classmethod
    def fit(cls, train: DataFrame, features: str | list[str]) -> Scaler:
        if isinstance(features, str):
            stats = long_values(train, features, []).groupBy("pos").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
            rows = sorted(bounded_rows(stats, MAX_FEATURES, "features"), key=lambda r: r["pos"])
            return cls(features, tuple(r["m"] for r in rows), tuple(r["s"] for r in rows))
        aggs = [F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in features]
        aggs += [F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in features]
        row = train.agg(*aggs).head()
        return cls(tuple(features), tuple(row[f"m_{c}"] for c in features), tuple(row[f"s_{c}"] for c in features))

    def to_df(self, spark: SparkSession) -> DataFrame:
        names = [self.features] * len(self.mean) if isinstance(self.features, str) else self.features
        rows = [(i, n, m, s) for i, (n, m, s) in enumerate(zip(names, self.mean, self.std))]
        return spark.createDataFrame(rows, "pos int, feature string, mean double, std double")

    def z(self, i: int, col: Column) -> Column:
        if not self.std[i]:
            return F.when(col.isNotNull(), F.lit(0.0))
        return (col.cast("double") - F.lit(self.mean[i])) / F.lit(self.std[i])

    def apply(self, df: DataFrame) -> DataFrame:
        """Scaled features under the same names, as doubles."""
        if isinstance(self.features, str):
            means = F.array(*[F.lit(m) for m in self.mean])
            # Dividing by an infinite deviation is how a constant feature becomes 0.
            stds = F.array(*[F.lit(s if s else float("inf")) for s in self.std])
            centred = F.zip_with(self.features, means, lambda x, m: x.cast("double") - m)
            return df.withColumn(self.features, F.zip_with(centred, stds, lambda x, s: x / s))
        return df.withColumns({c: self.z(i, F.col(c)) for i, c in enumerate(self.features)})


def align(df: DataFrame, mapping: dict[str, str], feature_names: list[str], dataset: str, keep: list[str] | None = None) -> DataFrame:
    """Bring a second source onto the fixed feature order; absent features are NULL."""
    picked = [
        (F.col(mapping[n]) if n in mapping else F.lit(None)).cast("double").alias(n) for n in feature_names
    ]
    return df.select(*(keep or []), *picked, F.lit(dataset).alias("dataset"))
