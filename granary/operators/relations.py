"""Relational helpers: work still to do, artifact checks, lookups, products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.plans.small import small_side

# Relative training speed of the known models, and the default.
MODEL_SPEED = {
    "Logistic Regression": 0.9,
    "Naive Bayes": 1.0,
    "Decision Tree": 0.7,
    "Random Forest": 0.5,
}
DEFAULT_SPEED = 0.5


def pending_inputs(files: DataFrame, completed: DataFrame, key: str = "path") -> DataFrame:
    """Files that the manifest does not list as completed."""
    return files.join(completed.select(key), key, "left_anti")


def done_inputs(files: DataFrame, completed: DataFrame, key: str = "path") -> DataFrame:
    """Files that the manifest lists as completed."""
    return files.join(completed.select(key), key, "left_semi")


def pending_trials(grid: DataFrame, results: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Grid rows without a result; ``keys`` come on top of model and combination."""
    on = [*keys, "model", "combo_idx"]
    return grid.join(results.select(*on), on, "left_anti")


def artifact_check(
    required: DataFrame, found: DataFrame, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Every required ``name`` (with ``keys``): OK with its size, or missing."""
    return required.join(found.select("name", "size"), "name", "left").select(
        *keys,
        "name",
        "size",
        F.when(F.col("size").isNull(), "missing").otherwise("OK").alias("status"),
    )


def all_present(checked: DataFrame) -> DataFrame:
    """One row: are all required artifacts there?"""
    return checked.agg(F.coalesce(F.bool_and(F.col("status") == "OK"), F.lit(True)).alias("all_ok"))


def lookup_speed(
    df: DataFrame, speeds: dict[str, float] | DataFrame | None = None, model: str = "model"
) -> DataFrame:
    """Add ``speed`` per model, with a default for unknown ones.

    A dict of constants becomes a literal map; a DataFrame ``(model, speed)`` is
    joined, broadcast once its size was checked.
    """
    if isinstance(speeds, DataFrame):
        side = small_side(speeds.select(F.col("model").alias(model), "speed"))
        joined = df.join(side, model, "left")
        return joined.withColumn("speed", F.coalesce("speed", F.lit(DEFAULT_SPEED)))
    table = MODEL_SPEED if speeds is None else speeds
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return df.withColumn(
        "speed", F.coalesce(F.try_element_at(literal, F.col(model)), F.lit(DEFAULT_SPEED))
    )


def distinct_labels(df: DataFrame, label: str = "Label") -> DataFrame:
    """The label strings, sorted."""
    return df.select(F.col(label).cast("string").alias(label)).distinct().orderBy(label)


def grid_product(df: DataFrame, lists: list[str], out: str = "combo_idx") -> DataFrame:
    """All combinations of the value lists in each row, the last list fastest.

    ``lists`` names array columns. Combinations are numbered from 1 by position,
    so nothing is sorted or shuffled.
    """
    rest = [c for c in df.columns if c not in lists]
    sizes = [f"__size{i}" for i in range(len(lists))]
    work = df.select(*rest, *lists, *[F.size(c).alias(s) for c, s in zip(lists, sizes)])
    for i, name in enumerate(lists):
        others = [c for c in work.columns if c != name]
        work = work.select(*others, F.posexplode(name).alias(f"__pos{i}", name))
    index = reduce(
        lambda acc, i: acc * F.col(sizes[i]).cast("bigint") + F.col(f"__pos{i}"),
        range(len(lists)),
        F.lit(0).cast("bigint"),
    )
    return work.select(*rest, (index + 1).alias(out), *lists)


def dedupe_last(df: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """One row per key: position of its first entry, value of its last one."""
    return df.groupBy(key).agg(
        F.min(position).alias("first_position"), F.max_by(value, position).alias(value)
    )


def newest(df: DataFrame, order: list[str], n: int = 300) -> DataFrame:
    """The ``n`` newest entries, newest first (a top-k, no full sort)."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)
