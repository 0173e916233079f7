"""The four classifiers on ``features array<double>`` and ``label_idx``."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.trees import TreesModel, fit_trees

VECTOR = "__vector"
PREDICTION = "prediction"

# Fixed value: default variance smoothing.
VAR_SMOOTHING = 1e-9


def with_vector(df: DataFrame, features: str = "features") -> DataFrame:
    return df.withColumn(VECTOR, array_to_vector(F.col(features)))


@dataclass
class GaussianModel:
    """Class numbers, row counts, means and population variances per feature."""

    labels: list[int]
    counts: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def largest_variance(self) -> float:
        """Largest feature variance over all rows, from the class statistics."""
        weights = (self.counts / self.counts.sum())[:, None]
        centre = (weights * self.means).sum(axis=0)
        spread = self.variances + (self.means - centre) ** 2
        return float((weights * spread).sum(axis=0).max())

    def predicted(self, features: str = "features", var_smoothing: float = VAR_SMOOTHING) -> Column:
        """Most likely class of a row, the lowest number on ties; evaluated in the JVM."""
        variances = self.variances + var_smoothing * self.largest_variance()
        priors = self.counts / self.counts.sum()
        classes = [
            {
                "label": label,
                "base": float(math.log(priors[i]) - 0.5 * np.log(2 * math.pi * variances[i]).sum()),
                "terms": [
                    {"m": float(m), "w": float(0.5 / v)} for m, v in zip(self.means[i], variances[i])
                ],
            }
            for i, label in enumerate(self.labels)
        ]
        literal = F.from_json(
            F.lit(json.dumps(classes)),
            "array<struct<label: int, base: double, terms: array<struct<m: double, w: double>>>>",
        )

        def score(c: Column) -> Column:
            distances = F.zip_with(
                F.col(features), c["terms"], lambda x, t: (x - t["m"]) * (x - t["m"]) * t["w"]
            )
            total = F.aggregate(distances, c["base"], lambda acc, d: acc - d)
            return F.struct(total.alias("score"), (-c["label"]).alias("earlier"))

        return -F.array_max(F.transform(literal, score))["earlier"]


def fit_gaussian_nb(df: DataFrame, features: str = "features", label: str = "label_idx") -> GaussianModel:
    """Class statistics from one combined aggregation; one row per class reaches the driver."""
    stats = (
        with_vector(df, features)
        .groupBy(F.col(label).cast("int").alias("label"))
        .agg(Summarizer.metrics("count", "mean", "variance").summary(F.col(VECTOR)).alias("s"))
        .select("label", "s.count", "s.mean", "s.variance")
        .orderBy("label")
        .collect()
    )
    counts = np.array([float(r["count"]) for r in stats])
    # The summarizer divides by n - 1.
    shrink = ((counts - 1) / counts)[:, None]
    return GaussianModel(
        [int(r["label"]) for r in stats],
        counts,
        np.array([r["mean"].toArray() for r in stats]),
        np.array([r["variance"].toArray() for r in stats]) * shrink,
    )


def gaussian_log_density(df: DataFrame, model: GaussianModel, var_smoothing: float = VAR_SMOOTHING) -> DataFrame:
    """Add the predicted class of every row."""
    return df.withColumn(PREDICTION, model.predicted(var_smoothing=var_smoothing).cast("double"))


def logistic_regression(params: dict, n_train: int) -> LogisticRegression:
    """L2-penalized; Spark's loss is a mean, so the penalty is ``1 / (C n)``."""
    return LogisticRegression(
        featuresCol=VECTOR,
        labelCol="label_idx",
        regParam=1.0 / (float(params.get("C", 1.0)) * max(n_train, 1)),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=int(params.get("max_iter", 100)),
    )


def fit_decision_tree(df: DataFrame, params: dict, trees: int | None = None) -> TreesModel:
    """A tree, or a forest of ``trees``; ``max_depth``, ``min_samples_split`` and ``min_samples_leaf`` are its limits."""
    return fit_trees(
        df,
        trees,
        int(params.get("max_depth", 30)),
        int(params.get("min_samples_split", 2)),
        int(params.get("min_samples_leaf", 1)),
    )


def fit_random_forest(df: DataFrame, params: dict) -> TreesModel:
    return fit_decision_tree(df, params, int(params.get("n_estimators", 100)))


def fit_predict(model: str, params: dict, train: DataFrame, test: DataFrame, n_train: int) -> DataFrame:
    """``test`` with ``prediction``, by a model of the given kind fitted on ``train``."""
    if model == "Naive Bayes":
        fitted = fit_gaussian_nb(train)
        smoothing = float(params.get("var_smoothing", VAR_SMOOTHING))
        return gaussian_log_density(test, fitted, smoothing)
    if model == "Logistic Regression":
        return predict(logistic_regression(params, n_train).fit(with_vector(train)), test)
    if model == "Decision Tree":
        return predict(fit_decision_tree(train, params), test)
    if model == "Random Forest":
        return predict(fit_random_forest(train, params), test)
    raise ValueError(f"unknown model {model}")


def predict(model, df: DataFrame) -> DataFrame:
    """Predicted class per row, for a fitted Spark ML model, a ``GaussianModel`` or a ``TreesModel``."""
    if isinstance(model, GaussianModel):
        return gaussian_log_density(df, model)
    if isinstance(model, TreesModel):
        return df.withColumn(PREDICTION, model.predicted())
    return model.transform(with_vector(df)).drop(VECTOR, "rawPrediction", "probability")
