"""Grid search: holdouts, fits, scores; resumable by a table of trials."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.scalars import quoted
from granary.operators.evaluation import PARAM_GRIDS, best_per_model, mean_score, param_grid
from granary.operators.features import build_training_matrix, scaled_values
from granary.operators.schema import LABEL, numeric_columns
from granary.operators.split import (
    HOLDOUTS,
    SEED,
    TEST_SHARE,
    TREE_TEST_SHARE,
    repeated_stratified_holdout,
)
from granary.plans.families import Matrix, checked, family_scores
from granary.session import in_many_tasks, shared_dir, written

TRIAL_SCHEMA = (
    "model_idx bigint, model string, combo_idx bigint, params map<string,string>, "
    "holdout int, f1 double, rows bigint, error string, passing boolean"
)


def prepare_search_table(
    df: DataFrame,
    key: str,
    k: int = HOLDOUTS,
    seed: int = SEED,
    features: list[str] | None = None,
    scaled: bool = True,
) -> DataFrame:
    """Matrix with holdout flags, written once: the fits read a compact table, and a
    lost executor costs a re-read, not a recomputation. So are the rows it is made of.

    ``scaled=False`` keeps raw features with holes, to be scaled per holdout.
    """
    features = features or [c for c in numeric_columns(df) if c != key]
    df = written(in_many_tasks(df.select(*[quoted(c) for c in dict.fromkeys([key, LABEL, *features])])), "search-rows")
    matrix = build_training_matrix(df, cols=features, keep=(key,), scale=scaled, clipped=True).data
    flagged = repeated_stratified_holdout(matrix, key, LABEL, k, TEST_SHARE, seed, "test_")
    flagged = repeated_stratified_holdout(flagged, key, LABEL, k, TREE_TEST_SHARE, seed, "tree_test_")
    return written(flagged.drop(LABEL), "search-table")


def scale_on(table: DataFrame, fit_rows, width: int) -> DataFrame:
    """Features imputed and standardized by the statistics of the rows ``fit_rows``."""
    values = [F.get("features", F.lit(i)) for i in range(width)]
    row = table.where(fit_rows).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(values)],
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)],
        *[F.var_pop(v).alias(f"v{i}") for i, v in enumerate(values)],
    ).first()
    return table.withColumn("features", F.array(*scaled_values(values, row)))


def _told() -> Column:
    """Parameters as one text, whatever the order of the map's entries."""
    return F.to_json(F.array_sort(F.map_entries("params")))


def search_key(df: DataFrame, key: str, k: int, names: list[str], fit_on: str) -> str:
    """Names everything that a score depends on besides model and parameters, the rows included."""
    cells = [F.col(key), F.col(LABEL), *[quoted(c) for c in names]]
    total = F.sum(F.xxhash64(*[c.cast("string") for c in cells]).cast("decimal(38,0)"))
    rows, content = df.agg(F.count(F.lit(1)), total).first()
    parts = [key, str(k), str(SEED), str(TEST_SHARE), str(TREE_TEST_SHARE), fit_on, *names, str(rows), str(content)]
    return hashlib.md5("\x1f".join(parts).encode()).hexdigest()[:16]


def read_trials(spark: SparkSession, results: str) -> DataFrame:
    """Holdout scores of all trials; ``passing`` errors are of trials that are still open."""
    return (
        spark.read.schema(TRIAL_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .json(results)
    )


def _flag(model: str, holdout: int) -> str:
    """Column that marks the held-out rows of a holdout for a model."""
    return f"{'tree_test_' if model == 'Decision Tree' else 'test_'}{holdout}"


def matrices(table: DataFrame, key: str, model: str, k: int, width: int, classes: int, scaled: bool) -> list[Matrix]:
    """What a model is fitted on: one matrix with all holdouts, or unless ``scaled`` one per holdout, scaled by its train rows."""
    flags = {i: _flag(model, i) for i in range(k)}
    if scaled:
        return [Matrix(table, width, classes, key, flags)]
    own = lambda flag: written(scale_on(table, ~F.col(flag), width), "scaled-rows")
    return [Matrix(own(flag), width, classes, key, {i: flag}) for i, flag in flags.items()]


def run_family(model: str, trials: list[dict], parts: Callable[[], list[Matrix]], results: str, rows: int, spark: SparkSession) -> None:
    """Score all combinations of a model on all holdouts, then write their scores as a unit.

    Parameters that no fit accepts score 0 for good. Any other error is tried once more; then it is
    written as a passing one, and the next search tries again.
    """
    good, scores, failed, passing = {}, {}, {}, None
    for trial in trials:
        try:
            checked(model, trial["params"])
            good[trial["combo_idx"]] = trial["params"]
        except (TypeError, ValueError) as exc:
            failed[trial["combo_idx"]] = f"{type(exc).__name__}: {exc}"
    holdouts: set[int] = set()
    for attempt in (1, 2):
        try:
            for matrix in parts():
                holdouts |= set(matrix.flags)
                scores |= family_scores(model, matrix, good) if good else {}
            passing = None
            break
        except Exception as exc:  # the reason is kept, the trials stay open
            passing = f"{type(exc).__name__}: {exc}"
    out = []
    for trial in trials:
        combo = trial["combo_idx"]
        error = failed.get(combo) or passing
        for i in sorted(holdouts) or [0]:
            row = (0.0, 0, error, combo not in failed) if error else (scores[(combo, i)], rows, None, False)
            out.append((trial["model_idx"], model, combo, trial["params"], i, *row))
    path = f"{results}/{re.sub(r'\W+', '_', model.lower())}-{uuid.uuid4().hex[:16]}"
    spark.createDataFrame(out, TRIAL_SCHEMA).coalesce(1).write.json(path)


def grid_search(
    df: DataFrame,
    key: str,
    grids: dict | None = None,
    k: int = HOLDOUTS,
    results: str | None = None,
    parallelism: int = 4,
    features: list[str] | None = None,
    fit_on: str = "all",
) -> DataFrame:
    """Mean weighted F1 per trial: ``(model_idx, model, combo_idx, params, f1, holdouts)``.

    ``fit_on="all"`` scales the features once by all rows; ``"train"`` scales
    them per holdout by its train rows, so that nothing held out leaks in.

    All combinations and holdouts of a model share their passes over the rows; ``parallelism`` models are
    worked on at a time. Trials already in ``results`` are skipped, unless an error that may pass ended them,
    so a search can be resumed: with the same rows, features, holdouts and scaling, whatever the rest of the
    grid; anything else starts afresh.
    """
    spark = df.sparkSession
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on is 'all' or 'train'")
    names = features or [c for c in numeric_columns(df) if c != key]
    folder = f"{(results or shared_dir(spark, 'trials')).rstrip('/')}/{search_key(df, key, k, names, fit_on)}"
    table = prepare_search_table(df, key, k, features=names, scaled=fit_on == "all")
    width = len(names) if fit_on == "train" else None
    experiments = spark.createDataFrame([(folder,)], "results string")
    grid = param_grid(experiments, PARAM_GRIDS if grids is None else grids).drop("results")
    # The grid is a short fixed list of parameter combinations.
    numbered = grid.withColumn("told", _told())
    try:
        done = read_trials(spark, folder).where("not passing").select("model", _told().alias("told")).distinct()
        todo = numbered.join(done, ["model", "told"], "left_anti")
        todo = todo.drop("told").orderBy("model_idx", "combo_idx").collect()
    except AnalysisException:  # no trial yet
        todo = grid.orderBy("model_idx", "combo_idx").collect()
    first = table.agg(F.count(F.lit(1)).alias("rows"), F.max("label_idx").alias("most")).first()
    classes = 1 + (first["most"] if first["most"] is not None else 0)
    by_model: dict[str, list[dict]] = {}
    for row in todo:
        by_model.setdefault(row["model"], []).append(row.asDict())
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        jobs = []
        for model, own in by_model.items():
            parts = partial(matrices, table, key, model, k, len(names), classes, fit_on == "all")
            jobs.append(pool.submit(run_family, model, own, parts, folder, first["rows"], spark))
        for job in jobs:
            job.result()
    runs = settled(read_trials(spark, folder).withColumn("told", _told()))
    numbers = numbered.select("model_idx", "model", "combo_idx", "params", "told")
    runs = runs.drop("model_idx", "combo_idx", "params", "passing")
    return trial_scores(runs.join(F.broadcast(numbers), ["model", "told"]))


def settled(runs: DataFrame) -> DataFrame:
    """One row per trial and holdout: a passing error only where there is nothing else."""
    best = F.min(F.struct("passing", *[c for c in runs.columns if c not in ("model", "told", "holdout", "passing", "params")])).alias("r")
    every = runs.groupBy("model", "told", "holdout").agg(best, F.any_value("params").alias("params"))
    every = every.select("model", "told", "holdout", "params", "r.*")
    final = every.where("not passing").select(F.col("model").alias("_m"), F.col("told").alias("_t")).distinct()
    joined = every.join(F.broadcast(final), (F.col("model") == F.col("_m")) & (F.col("told") == F.col("_t")), "left")
    return joined.where(F.col("_m").isNull() | ~F.col("passing")).drop("_m", "_t")


def trial_scores(runs: DataFrame) -> DataFrame:
    """Mean score per trial with its parameters and the first error, if any."""
    by = ("model_idx", "model", "combo_idx")
    info = runs.groupBy(*by).agg(
        F.any_value("params").alias("params"), F.max("error").alias("error")
    )
    return mean_score(runs, by).join(info, list(by)).select(
        *by, "params", "f1", "holdouts", "error"
    )


def optimal_configs(trials: DataFrame) -> DataFrame:
    return best_per_model(trials).orderBy("model")
