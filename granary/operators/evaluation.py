"""Scores of predictions and of hyper-parameter trials."""

from __future__ import annotations

import json
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.scalars import canonical_value
from granary.plans.slices import PART, add_parts, before, part_window, upto, with_carry

# The hyper-parameter grids; the last parameter varies fastest.
PARAM_GRIDS = {
    "Logistic Regression": {
        "C": (0.1, 1, 10),
        "max_iter": (1000, 2000),
        "penalty": ("l2",),
    },
    "Naive Bayes": {"var_smoothing": (1e-9, 1e-8, 1e-7)},
    "Decision Tree": {
        "max_depth": (10, 15, 20),
        "min_samples_split": (5, 10, 20),
        "min_samples_leaf": (2, 5, 10),
    },
    "Random Forest": {
        "n_estimators": (50, 100, 200),
        "max_depth": (15, 20),
        "min_samples_split": (5, 10),
        "min_samples_leaf": (2, 5),
    },
}

# Trials of one model lie in blocks of this many combinations.
COMBO_BLOCK = 4096


def param_grid(experiments: DataFrame, grids: dict | None = None) -> DataFrame:
    """Every combination of every model for each experiment row.

    Adds ``model_idx``, ``model``, ``combo_idx`` (from 1) and ``params``, a map of
    texts. The combinations are one literal, exploded in place: nothing moves.
    """
    grids = PARAM_GRIDS if grids is None else grids
    trials = [
        {
            "model_idx": position,
            "model": model,
            "combo_idx": number,
            "params": dict(zip(lists, map(str, values))),
        }
        for position, (model, lists) in enumerate(grids.items(), 1)
        for number, values in enumerate(product(*lists.values()), 1)
    ]
    kind = "array<struct<model_idx: bigint, model: string, combo_idx: bigint, params: map<string, string>>>"
    literal = F.from_json(F.lit(json.dumps(trials)), kind)
    rows = experiments.select("*", F.explode(literal).alias("__trial"))
    return rows.select(*experiments.columns, "__trial.*")


def confusion_matrix(
    df: DataFrame, actual: str, predicted: str, by: tuple[str, ...] = ()
) -> DataFrame:
    """``(actual, predicted, n)``, combined before the shuffle."""
    return df.groupBy(
        *by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))


def per_class_scores(confusion: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Support, predicted rows, precision, recall and F1 per class; 0 where undefined."""
    n = F.col("n")
    zero = F.lit(0).cast("bigint")
    shares = confusion.select(
        *by,
        F.explode(
            F.array(
                F.struct(
                    F.col("actual").alias("label"),
                    n.alias("support"),
                    zero.alias("predicted"),
                    F.when(F.col("actual") == F.col("predicted"), n).otherwise(zero).alias("hits"),
                ),
                F.struct(
                    F.col("predicted").alias("label"),
                    zero.alias("support"),
                    n.alias("predicted"),
                    zero.alias("hits"),
                ),
            )
        ).alias("s"),
    ).select(*by, "s.*")
    totals = shares.groupBy(*by, "label").agg(
        F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"),
        F.sum("hits").alias("hits"),
    )

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    return totals.select(
        *by,
        "label",
        "support",
        "predicted",
        ratio(hits, predicted).alias("precision"),
        ratio(hits, support).alias("recall"),
        ratio(2 * hits, support + predicted).alias("f1"),
    )


def weighted_f1(
    df: DataFrame, actual: str, predicted: str, by: tuple[str, ...] = ()
) -> DataFrame:
    """Support-weighted mean of the per-class F1 scores."""
    return weighted_f1_of(confusion_matrix(df, actual, predicted, by), by)


def weighted_f1_of(confusion: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``weighted_f1`` from the counts of a confusion matrix."""
    return per_class_scores(confusion, by).groupBy(*by).agg(
        F.coalesce(F.sum(F.col("support") * F.col("f1")) / F.sum("support"), F.lit(0.0)).alias("f1")
    )


def mean_score(runs: DataFrame, by: tuple[str, ...] = ("model", "combo_idx")) -> DataFrame:
    """Mean F1 over the holdouts of a trial; 0 when there is none."""
    return runs.groupBy(*by).agg(
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1"), F.count("f1").alias("holdouts")
    )


def failed_trials_as_zero(
    grid: DataFrame, results: DataFrame, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Every trial of the grid; one without a score gets 0 and an ``error`` text."""
    on = [*keys, "model", "combo_idx"]
    joined = grid.join(results.select(*on, F.col("f1").alias("__f1")), on, "left")
    return joined.select(
        *grid.columns,
        F.coalesce("__f1", F.lit(0.0)).alias("f1"),
        F.when(F.col("__f1").isNull(), "no score").alias("error"),
    )


def _first_best():
    """Order in which a trial beats another: higher score, then the earlier one; needs > 0."""
    return F.when(F.col("f1") > 0, F.struct(F.col("f1"), (-F.col("combo_idx")).alias("earlier")))


def best_per_model(trials: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """First best trial per model; combination and parameters are NULL if no score is > 0."""
    best = trials.groupBy(*keys, "model").agg(
        F.max_by(F.struct("combo_idx", "params"), _first_best()).alias("b"),
        F.coalesce(F.max(F.when(F.col("f1") > 0, F.col("f1"))), F.lit(0.0)).alias("f1_score"),
    )
    return best.select(
        *keys,
        "model",
        F.col("b.combo_idx").alias("combo_idx"),
        F.col("b.params").alias("params"),
        "f1_score",
    )


def running_best(trials: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Best score of a model so far, from 0, after each combination."""
    blocked = trials.withColumn("__block", F.floor(F.col("combo_idx") / COMBO_BLOCK))
    parted = add_parts(blocked, [*keys, "model"], slices=["__block"])
    local = parted.withColumn("__here", F.max("f1").over(upto(part_window(["combo_idx"]))))
    carried = with_carry(
        local, {"__max": F.max("f1")}, {"__ahead": lambda w: F.max("__max").over(before(w))}
    )
    best = F.greatest("__here", "__ahead", F.lit(0.0))
    return carried.withColumn("best_so_far", best).drop("__here", "__ahead", "__block", PART)


def canonical_params(trials: DataFrame) -> DataFrame:
    """Parameter values as canonical texts, so that ``1`` and ``1.0`` compare equal."""
    return trials.withColumn("params", F.transform_values("params", lambda k, v: canonical_value(v)))
