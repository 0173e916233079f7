"""Consistency checks of a feature matrix: ``(check_name, status, detail)`` rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OK, ERROR = "OK", "ERROR"

# The parts a stored matrix must have.
REQUIRED_FIELDS = ("X", "y", "numeric_cols", "classes")


def _check(name: str, passed: Column, good: Column, bad: Column) -> list[Column]:
    return [
        F.lit(name).alias("check_name"),
        F.when(passed, OK).otherwise(ERROR).alias("status"),
        F.when(passed, good).otherwise(bad).alias("detail"),
    ]


def missing_fields(parts: DataFrame, required: tuple[str, ...] = REQUIRED_FIELDS) -> DataFrame:
    """One row per required field that the ``(name)`` relation lacks."""
    wanted = parts.sparkSession.createDataFrame([(f,) for f in required], "name string")
    return wanted.join(parts.select("name"), "name", "left_anti")


def check_required_fields(parts: DataFrame, required: tuple[str, ...] = REQUIRED_FIELDS) -> DataFrame:
    held = F.array_intersect(F.array(*[F.lit(f) for f in required]), F.collect_set("name"))
    lacking = F.array_sort(F.array_except(F.array(*[F.lit(f) for f in required]), held))
    found = parts.where(F.col("name").isin(*required)).agg(lacking.alias("lacking"))
    text = F.array_join("lacking", ", ")
    return found.select(
        *_check("required_fields", F.size("lacking") == 0, F.lit(""), F.concat(F.lit("missing: "), text))
    )


def check_row_alignment(df: DataFrame, features: str = "features", label: str = "label_idx") -> DataFrame:
    counts = df.agg(F.count(features).alias("x"), F.count(label).alias("y"))
    pair = F.concat_ws("/", F.col("x").cast("string"), F.col("y").cast("string"))
    return counts.select(*_check("row_alignment", F.col("x") == F.col("y"), pair, pair))


def check_width(df: DataFrame, width: int, features: str = "features") -> DataFrame:
    sizes = df.agg(F.min(F.size(features)).alias("lo"), F.max(F.size(features)).alias("hi"))
    fits = F.coalesce((F.col("lo") == width) & (F.col("hi") == width), F.lit(True))
    text = F.concat(
        F.concat_ws("..", F.col("lo").cast("string"), F.col("hi").cast("string")),
        F.lit(f" of {width}"),
    )
    return sizes.select(*_check("width", fits, text, text))


def check_label_range(df: DataFrame, classes: int, label: str = "label_idx") -> DataFrame:
    """Label numbers within 0..classes-1; an empty matrix passes."""
    ends = df.agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
    fits = F.coalesce((F.col("lo") >= 0) & (F.col("hi") < classes), F.lit(True))
    text = F.concat(
        F.concat_ws("..", F.col("lo").cast("string"), F.col("hi").cast("string")),
        F.lit(f" of {classes}"),
    )
    return ends.select(*_check("label_range", fits, text, text))


def check_column_alignment(matrix_columns: DataFrame, table_columns: DataFrame) -> DataFrame:
    """Names held by one side only: ``(side, name)``; empty when they agree."""
    here = matrix_columns.select("name").join(table_columns.select("name"), "name", "left_anti")
    there = table_columns.select("name").join(matrix_columns.select("name"), "name", "left_anti")
    return here.select(F.lit("matrix").alias("side"), "name").unionByName(
        there.select(F.lit("table").alias("side"), "name")
    )


def all_checks(df: DataFrame, width: int, classes: int) -> DataFrame:
    """Row alignment, width and label range in one relation."""
    parts = [check_row_alignment(df), check_width(df, width), check_label_range(df, classes)]
    return reduce(DataFrame.unionByName, parts)


def verdict(checks: DataFrame) -> DataFrame:
    return checks.agg(F.coalesce(F.bool_and(F.col("status") != ERROR), F.lit(True)).alias("passed"))
