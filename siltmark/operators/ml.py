"""spark.ml models and user-supplied networks behind the same contract."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.functions.sizing import known_classes
from siltmark.functions.vectors import width_of

KINDS = ("mlp", "logreg")
#: L2 penalties of a logistic regression that validation rows choose from.
PENALTIES = (0.0, 0.01, 0.1)
LEAST_PROB = 1e-15


@dataclass
class MLClassifier:
    """``class_ids`` fixes the output width: classes of later tasks can be listed up front.

    With validation rows a perceptron is fitted ``check_every`` iterations at a time, stops once
    ``patience`` checks in a row brought no lower validation loss, and keeps the best weights; a
    logistic regression takes the penalty with the lowest validation loss. ``val_losses`` holds
    what was measured, in order.
    """

    kind: str = "mlp"
    features: str = "features"
    label: str = "label"
    class_ids: list[int] = field(default_factory=list)
    hidden: tuple[int, ...] = (16,)
    max_iter: int = 20
    seed: int = 0
    model: object = None
    losses: list[float] = field(default_factory=list)
    check_every: int = 5
    patience: int = 2
    val_losses: list[float] = field(default_factory=list)

    def fit(self, train: DataFrame, val: DataFrame | None = None, replay: DataFrame | None = None) -> MLClassifier:
        rows = train if replay is None else train.unionByName(replay, allowMissingColumns=True)
        if not self.class_ids:
            self.class_ids = known_classes(rows, self.label)
        return self._fit(rows, None) if val is None else self._fit_validated(rows, val, None)

    @property
    def continues(self) -> bool:
        """Whether :meth:`update` can go on from this model's weights."""
        return self.kind == "mlp" and self.model is not None

    def update(self, train: DataFrame, replay: DataFrame | None = None, val: DataFrame | None = None) -> MLClassifier:
        """Sequential fine-tuning: continue from the current weights on new rows."""
        if not self.continues:
            raise ValueError("update continues a fitted mlp")
        rows = train if replay is None else train.unionByName(replay, allowMissingColumns=True)
        following = MLClassifier(self.kind, self.features, self.label, list(self.class_ids), self.hidden, self.max_iter, self.seed)
        following.check_every, following.patience = self.check_every, self.patience
        return following._fit(rows, self.model.weights) if val is None else following._fit_validated(rows, val, self.model.weights)

    def validation_loss(self, val: DataFrame) -> float | None:
        """Mean negative log probability of the claimed class over rows of known classes; None without any."""
        at = F.array_position(self._ids(), F.col(self.label).cast("int")).cast("int")
        prob = F.greatest(F.try_element_at("probs", at), F.lit(LEAST_PROB))
        known = val.where(F.col(self.label).cast("int").isin([int(c) for c in self.class_ids]))
        return self.predict_proba(known).agg(F.avg(-F.log(prob))).head()[0]

    def _fit_validated(self, rows: DataFrame, val: DataFrame, weights) -> MLClassifier:
        """Fit in steps and keep the step with the lowest validation loss, the first of equal ones.
        Validation rows of no known class decide nothing: the fit runs to its end."""
        start = weights
        steps = -(-self.max_iter // self.check_every) if self.kind == "mlp" else len(PENALTIES)
        best, best_loss, losses, kept, last = None, float("inf"), [], 0, self.max_iter
        for i in range(steps):
            self.max_iter = min(self.check_every, last - i * self.check_every) if self.kind == "mlp" else last
            try:
                self._fit(rows, weights, PENALTIES[i] if self.kind == "logreg" else 0.0)
            finally:
                self.max_iter = last
            weights = self.model.weights if self.kind == "mlp" else None
            losses = [*losses, *self.losses] if self.kind == "mlp" else self.losses
            loss = self.validation_loss(val)
            if loss is None:
                return self._fit(rows, start)
            self.val_losses.append(float(loss))
            if best is None or loss < best_loss:
                best, best_loss, best_losses, kept = self.model, loss, losses, i
            if self.kind == "mlp" and i - kept >= self.patience:
                break
        self.model, self.losses = best, best_losses
        return self

    def _fit(self, rows: DataFrame, weights, penalty: float = 0.0) -> MLClassifier:
        index = F.array_position(self._ids(), F.col(self.label).cast("int")) - 1
        data = rows.select(self._vector().alias("_v"), index.cast("double").alias("_y")).where(F.col("_y") >= 0)
        if self.kind == "mlp":
            layers = [width_of(rows, self.features), *self.hidden, len(self.class_ids)]
            est = MultilayerPerceptronClassifier(
                featuresCol="_v", labelCol="_y", layers=layers, maxIter=self.max_iter, seed=self.seed
            )
            if weights is not None:
                est = est.setInitialWeights(weights)
        elif self.kind == "logreg":
            est = LogisticRegression(featuresCol="_v", labelCol="_y", maxIter=self.max_iter, regParam=penalty, family="multinomial")
        else:
            raise ValueError(f"kind must be one of {KINDS}")
        self.model = est.fit(data)
        summary = self.model.summary() if self.kind == "mlp" else self.model.summary
        self.losses = [float(v) for v in summary.objectiveHistory]
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Add ``probs``, aligned with ``class_ids`` (0 for a class the model has not seen)."""
        names = [c for c in ("_v", "rawPrediction", "prediction", "probability")]
        scored = self.model.transform(df.withColumn("_v", self._vector()))
        probs = vector_to_array("probability")
        width = len(self.class_ids)
        padded = F.slice(F.concat(probs, F.array_repeat(F.lit(0.0), width)), 1, width)
        return scored.withColumn("probs", padded).drop(*names)

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.predict_proba(df).withColumn("max_prob", F.array_max("probs"))
        at = F.array_position(F.col("probs"), F.col("max_prob")).cast("int")
        return scored.withColumn("pred", F.try_element_at(self._ids(), at))

    def history(self, spark: SparkSession) -> DataFrame:
        rows = [(i, v) for i, v in enumerate(self.losses)]
        return spark.createDataFrame(rows, "iteration int, loss double")

    def size(self) -> dict[str, int]:
        n = self.model.weights.size if self.kind == "mlp" else self.model.coefficientMatrix.toArray().size + len(self.class_ids)
        return {"parameters": int(n), "bytes": 8 * int(n)}

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        meta = [(self.kind, self.features, self.label, [int(c) for c in self.class_ids], list(self.hidden), self.max_iter, self.seed, self.losses)]
        schema = "kind string, features string, label string, class_ids array<int>, hidden array<int>, max_iter int, seed int, losses array<double>"
        spark.createDataFrame(meta, schema).coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MLClassifier:
        schema = "kind string, features string, label string, class_ids array<int>, hidden array<int>, max_iter int, seed int, losses array<double>"
        m = spark.read.schema(schema).json(f"{path}/meta").head()
        reader = MultilayerPerceptronClassificationModel if m["kind"] == "mlp" else LogisticRegressionModel
        return cls(
            m["kind"], m["features"], m["label"], list(m["class_ids"]), tuple(m["hidden"]), m["max_iter"], m["seed"],
            reader.load(f"{path}/model"), list(m["losses"]),
        )

    def _vector(self) -> Column:
        return array_to_vector(F.col(self.features).cast("array<double>"))

    def _ids(self) -> Column:
        return F.array(*[F.lit(int(c)) for c in self.class_ids])


def score_with(
    make_predict_fn: Callable, df: DataFrame, features: str = "features", width: int | None = None, batch_size: int = 1024
) -> DataFrame:
    """Add ``probs`` from any batch model; ``make_predict_fn`` loads it once per worker."""
    n = width or width_of(df, features)
    run = predict_batch_udf(
        make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[[n]]
    )
    return df.withColumn("probs", run(F.col(features)))
