"""Analytics over trials ``(model, combo_idx, params, f1)``.

Every operator takes optional experiment ``keys``, so that the trials of many
experiments are analysed in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.scalars import at_least, at_most, canonical_value, map_size
from granary.operators.evaluation import COMBO_BLOCK, best_per_model
from granary.operators.relations import lookup_speed
from granary.plans.slices import add_parts, before, part_window, throughout, with_carry

# Sensitivity tiers, lower bound of the mean in stability,
# stability without results, parameter count taken as most complex.
HIGH_SENSITIVITY, MEDIUM_SENSITIVITY = 0.05, 0.02
MEAN_FLOOR = 0.1
NO_RESULT_STABILITY = 0.5
MOST_PARAMS = 8


def _with_top(trials: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Add each trial's position and its model's first maximum."""
    blocked = trials.withColumn("__block", F.floor(F.col("combo_idx") / COMBO_BLOCK)).withColumn(
        "__score", F.coalesce("f1", F.lit(0.0))
    )
    parted = add_parts(blocked, [*keys, "model"], slices=["__block"])
    local = parted.withColumn("__local", F.row_number().over(part_window(["combo_idx"])))
    rank = F.struct(F.col("__score"), (-F.col("combo_idx")).alias("earlier"))
    return with_carry(
        local,
        {"__count": F.count(F.lit(1)), "__best": F.max(rank)},
        {
            "__ahead": lambda w: F.coalesce(F.sum("__count").over(before(w)), F.lit(0)),
            "__top": lambda w: F.max("__best").over(throughout(w)),
        },
    )


def _is_top() -> Column:
    return F.col("combo_idx") == -F.col("__top.earlier")


def score_progression(trials: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Position of each trial from 1, its score (missing = 0), and the first maximum's flag."""
    return _with_top(trials, keys).select(
        *keys,
        "model",
        "combo_idx",
        (F.col("__local") + F.col("__ahead")).cast("bigint").alias("position"),
        F.col("__score").alias("f1"),
        _is_top().alias("is_best"),
    )


def compare_models(best: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Best score per model beside the mean over the models of the experiment."""
    group = Window.partitionBy(*keys)
    return best.select(
        *keys, "model", "f1_score", F.avg("f1_score").over(group).alias("mean_f1")
    )


def stability(trials: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``1 - std / max(mean, 0.1)`` of a model's scores, kept within 0..1."""
    score = F.coalesce("f1", F.lit(0.0))
    raw = 1.0 - F.stddev_pop(score) / F.greatest(F.avg(score), F.lit(MEAN_FLOOR))
    return trials.groupBy(*keys, "model").agg(at_most(at_least(raw, 0.0), 1.0).alias("stability"))


def simplicity(params: Column | str = "params") -> Column:
    """1 for no parameter, down to 0 for eight or more."""
    return 1.0 - F.least(map_size(params) / F.lit(float(MOST_PARAMS)), F.lit(1.0))


def model_profile(
    best: DataFrame, trials: DataFrame, keys: tuple[str, ...] = (), speeds=None
) -> DataFrame:
    """Score, stability, simplicity and speed per model."""
    steady = stability(trials, keys)
    joined = best.join(steady, [*keys, "model"], "left")
    return lookup_speed(joined, speeds).select(
        *keys,
        "model",
        "f1_score",
        F.coalesce("stability", F.lit(NO_RESULT_STABILITY)).alias("stability"),
        simplicity().alias("simplicity"),
        "speed",
    )


def sensitivity_tier(c: Column) -> Column:
    return (
        F.when(c > HIGH_SENSITIVITY, "high").when(c > MEDIUM_SENSITIVITY, "medium").otherwise("low")
    )


def param_sensitivity(
    trials: DataFrame, keys: tuple[str, ...] = (), last_model_wins: bool = False
) -> DataFrame:
    """Spread of the mean score over the values of each parameter, with its tier.

    Only parameters of a model's first trial that take several values count.
    ``last_model_wins`` keeps one row per parameter name, of the model with the
    highest ``model_idx``.
    """
    order = ["model_idx"] if last_model_wins else []
    entries = trials.select(
        *keys,
        "model",
        *order,
        "combo_idx",
        F.coalesce("f1", F.lit(0.0)).alias("f1"),
        F.explode("params").alias("param", "value"),
    )
    by_value = entries.groupBy(
        *keys, "model", *order, "param", canonical_value("value").alias("value")
    ).agg(F.avg("f1").alias("mean"), F.min("combo_idx").alias("first"))
    by_param = by_value.groupBy(*keys, "model", *order, "param").agg(
        F.stddev_pop("mean").alias("sensitivity"),
        F.count(F.lit(1)).alias("values_seen"),
        F.min("first").alias("first"),
    )
    # A model's parameters are a handful of rows here.
    first_trial = F.min("first").over(Window.partitionBy(*keys, "model"))
    kept = (
        by_param.withColumn("__first_trial", first_trial)
        .where((F.col("first") == F.col("__first_trial")) & (F.col("values_seen") > 1))
        .select(*keys, "model", *order, "param", "sensitivity")
    )
    if last_model_wins:
        kept = kept.groupBy(*keys, "param").agg(
            F.max_by(F.struct("model", "sensitivity"), "model_idx").alias("last")
        ).select(*keys, "param", "last.model", "last.sensitivity")
    return kept.withColumn("tier", sensitivity_tier(F.col("sensitivity")))


def score_vs_complexity(trials: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Number of parameters and score per trial; the first best trial is flagged."""
    return _with_top(trials, keys).select(
        *keys,
        "model",
        "combo_idx",
        map_size("params").alias("n_params"),
        F.col("__score").alias("f1"),
        (_is_top() & (F.col("__score") > 0)).alias("is_best"),
    )


def rank_configs(best: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Models numbered by best score, one row per parameter of the best trial."""
    # One row per model: the window never holds more than the models of an experiment.
    place = F.row_number().over(
        Window.partitionBy(*keys).orderBy(F.desc("f1_score"), F.asc("model"))
    )
    ranked = best.withColumn("place", place.cast("bigint"))
    return ranked.select(
        *keys, "place", "model", "f1_score", F.explode_outer("params").alias("param", "value")
    )


def results_summary(trials: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Models, trials and best score."""
    return trials.groupBy(*keys).agg(
        F.count_distinct("model").alias("n_models"),
        F.count(F.lit(1)).alias("n_combos"),
        F.greatest(F.coalesce(F.max("f1"), F.lit(0.0)), F.lit(0.0)).alias("best_score"),
    )


def analyse(trials: DataFrame, keys: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """All reports over one set of trials."""
    best = best_per_model(trials, keys)
    return {
        "progression": score_progression(trials, keys),
        "comparison": compare_models(best, keys),
        "profile": model_profile(best, trials, keys),
        "sensitivity": param_sensitivity(trials, keys),
        "complexity": score_vs_complexity(trials, keys),
        "ranking": rank_configs(best, keys),
        "summary": results_summary(trials, keys),
    }
