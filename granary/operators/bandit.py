"""LinUCB statistics and scores over logged samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.scalars import linear_form, quadratic_form

# Number of context features, exploration weight, and the
# actions as (change of workers, chunk factor).
DIMENSIONS = 5
ALPHA = 1.1
ACTIONS = (
    (-2, 0.85), (-1, 0.90), (0, 0.95), (0, 1.00), (0, 1.05), (1, 1.10), (2, 1.15),
)


def linucb_statistics(
    df: DataFrame, action: str, features: list[str], reward: str
) -> DataFrame:
    """Per action ``a`` (row-major I + sum of x x') and ``b`` (sum of r x); NULL actions are skipped."""
    d = len(features)
    products = [
        F.sum(F.col(features[i]) * F.col(features[j])) + F.lit(1.0 if i == j else 0.0)
        for i in range(d)
        for j in range(d)
    ]
    weighted = [F.sum(F.col(reward) * F.col(f)) for f in features]
    return (
        df.where(F.col(action).isNotNull())
        .groupBy(F.col(action).alias("action"))
        .agg(F.count(F.lit(1)).alias("n"), F.array(*products).alias("a"), F.array(*weighted).alias("b"))
    )


def linucb_scores(
    df: DataFrame,
    statistics: DataFrame,
    features: list[str],
    n_actions: int = len(ACTIONS),
    alpha: float = ALPHA,
) -> DataFrame:
    """Upper confidence score of every action per row, and the first best action.

    The statistics hold one small matrix per action; their inverses enter the
    projection as literals.
    """
    d = len(features)
    fitted = {
        r["action"]: (np.array(r["a"]).reshape(d, d), np.array(r["b"]))
        for r in statistics.where(F.col("action") < n_actions).collect()
    }
    x = [F.col(f).cast("double") for f in features]
    scores: list[Column] = []
    for i in range(n_actions):
        a, b = fitted.get(i, (np.eye(d), np.zeros(d)))
        inverse = np.linalg.inv(a)
        spread = F.sqrt(F.greatest(quadratic_form(x, inverse.tolist()), F.lit(0.0)))
        scores.append(linear_form(x, (inverse @ b).tolist()) + F.lit(alpha) * spread)
    ranked = F.array(
        *[F.struct(s.alias("score"), F.lit(-i).alias("earlier")) for i, s in enumerate(scores)]
    )
    return (
        df.withColumn("__best", F.array_max(ranked))
        .withColumn("best_action", (-F.col("__best.earlier")).cast("bigint"))
        .withColumn("best_score", F.col("__best.score"))
        .drop("__best")
    )


def action_effect(action: Column) -> tuple[Column, Column]:
    """Change of workers and chunk factor of an action number."""
    workers = F.array(*[F.lit(w) for w, _ in ACTIONS])
    factors = F.array(*[F.lit(f) for _, f in ACTIONS])
    return F.get(workers, action.cast("int")), F.get(factors, action.cast("int"))
