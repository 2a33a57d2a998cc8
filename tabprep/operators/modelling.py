"""Logistic regression and other Spark ML estimators; scoring as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.base import Fitted, Step
from tabprep.functions.columns import add_all, as_double, col, numeric_columns
from tabprep.functions.joins import salted_join
from tabprep.operators.sampling import with_class_weights
from tabprep.operators.schema import align_schema, clean_infinite


@dataclass
class FittedLogistic(Fitted):
    """Coefficients of a logistic model; scores any batch or stream with one projection."""

    features: list
    coefficients: list
    intercepts: list
    labels: list = field(default_factory=lambda: [0, 1])

    def _checked(self, df: DataFrame) -> None:
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise ValueError(f"features are absent: {missing}")

    def _margins(self) -> list[Column]:
        return [F.lit(b) + add_all([as_double(c) * F.lit(w) for c, w in zip(self.features, ws, strict=True)])
                for ws, b in zip(self.coefficients, self.intercepts, strict=True)]

    def probabilities(self) -> list[Column]:
        margins = self._margins()
        if len(margins) == 1:
            p = 1.0 / (1.0 + F.exp(-margins[0]))
            return [1.0 - p, p]
        top = F.greatest(*margins)
        powers = [F.exp(m - top) for m in margins]
        return [p / add_all(powers) for p in powers]

    def predicted(self) -> Column:
        p = self.probabilities()
        if len(p) == 2:
            return F.when(p[1] >= 0.5, F.lit(self.labels[1])).otherwise(F.lit(self.labels[0]))
        top = F.greatest(*p)
        return F.coalesce(*[F.when(x == top, F.lit(label)) for x, label in zip(p, self.labels, strict=True)])

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        self._checked(df)
        return df.withColumn(name, self.predicted())

    def predict_proba(self, df: DataFrame) -> DataFrame:
        self._checked(df)
        return df.select("*", *[p.alias(f"probability_{label}")
                                for p, label in zip(self.probabilities(), self.labels, strict=True)])

    def transform(self, df: DataFrame) -> DataFrame:
        return self.predict_proba(self.predict(df))


@dataclass
class LogisticTrainer(Step):
    """L2 logistic regression with balanced class weights.

    The penalty ``c`` weighs the loss summed over rows, as in the usual single-machine solvers; Spark
    averages the loss, hence regParam = 1 / (c * sum of weights). The intercept is not penalised.
    """

    c: float = 1.0
    features: Sequence[str] | None = None
    balanced: bool = True
    max_iter: int = 100

    def fit(self, df: DataFrame, target: str | None = None) -> FittedLogistic:
        if target is None:
            raise ValueError("a target column is needed")
        names = list(self.features) if self.features is not None else numeric_columns(df, [target])
        known = df.where(col(target).isNotNull())
        weighted = (with_class_weights(known, target, "__weight") if self.balanced
                    else known.withColumn("__weight", F.lit(1.0)))
        # one label per row of the coefficients, which sit on the driver as well
        labels = sorted(r[0] for r in known.select(col(target)).distinct().collect())
        kind = known.schema[target].dataType.simpleString()
        codes = df.sparkSession.createDataFrame([(v, float(i)) for i, v in enumerate(labels)], f"__label {kind}, label double")
        rows = salted_join(weighted.select(*[as_double(c).alias(f"x{i}") for i, c in enumerate(names)],
                                           col(target).alias("__target"), "__weight"), codes, ["__target"], ["__label"])
        vectors = VectorAssembler(inputCols=[f"x{i}" for i in range(len(names))],
                                  outputCol="features").transform(rows)
        total = rows.agg(F.sum("__weight")).first()[0]
        model = LogisticRegression(
            weightCol="__weight", regParam=1.0 / (self.c * total), elasticNetParam=0.0,
            standardization=False, maxIter=self.max_iter, tol=1e-10).fit(
                vectors.select("features", "label", "__weight"))
        matrix = model.coefficientMatrix.toArray()
        return FittedLogistic(names, matrix.tolist(), model.interceptVector.toArray().tolist(), labels)


def train(df: DataFrame, features: Sequence[str], target: str, estimator: Estimator) -> Model:
    """Fit any Spark ML estimator on assembled features and a ``label`` column."""
    rows = df.select(*[as_double(c).alias(c) for c in features], as_double(target).alias("label"))
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    return estimator.fit(vectors.select("features", "label"))


def score_batch(df: DataFrame, schema: Sequence[Mapping[str, str]], model: FittedLogistic,
                prepare: Fitted | None = None) -> DataFrame:
    """Align to the saved schema, prepare, clean infinite values, append ``Prediction`` and
    ``Prob_{label}``. One projection, on a table, a single row, or a stream."""
    aligned = align_schema(df, schema)
    ready = clean_infinite(prepare.transform(aligned) if prepare is not None else aligned)
    model._checked(ready)
    return ready.select("*", model.predicted().alias("Prediction"),
                        *[p.alias(f"Prob_{label}")
                          for p, label in zip(model.probabilities(), model.labels, strict=True)])
