"""Text, JSON and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.scalars import (
    datetime_text,
    file_size_text,
    fixed_decimals,
    hours_minutes,
    human_bytes,
    params_text,
)
from granary.operators.relations import artifact_check
from granary.sources.files import discover_files


def report_lines(best: DataFrame) -> DataFrame:
    """``(model, line, params_line)``: name padded to 25, score in width 7 with 4 decimals."""
    text = F.coalesce(params_text("params"), F.lit("None"))
    return best.select(
        "model",
        F.concat(F.format_string("%-25s F1:", "model"), fixed_decimals("f1_score", 4, 7)).alias("line"),
        F.concat(F.lit("  Params: "), text).alias("params_line"),
    )


def write_report_text(best: DataFrame, path: str) -> None:
    """The report as one text file, models by name; it has one entry per model."""
    lines = report_lines(best).orderBy("model").coalesce(1)
    entry = F.concat_ws("\n", "line", "params_line", F.lit(""))
    lines.select(entry.alias("value")).write.mode("overwrite").text(path)


def report_json(best: DataFrame) -> DataFrame:
    """``(model, config)``: the best configuration of each model as JSON."""
    config = F.to_json(F.struct("params", "f1_score"))
    return best.select("model", config.alias("config"))


def export_json(best: DataFrame, keys: tuple[str, ...] = (), now: Column | None = None) -> DataFrame:
    """One JSON document per experiment: timestamp, models, summary.

    The models of one experiment are a handful of rows.
    """
    stamp = F.date_format(F.current_timestamp() if now is None else now, "yyyyMMdd_HHmmss")
    grouped = best.groupBy(*keys).agg(
        F.map_from_entries(
            F.collect_list(F.struct("model", F.struct("params", "f1_score")))
        ).alias("models"),
        F.count(F.lit(1)).alias("n_models"),
        F.coalesce(F.max("f1_score"), F.lit(0.0)).alias("best_score"),
    )
    document = F.struct(
        stamp.alias("timestamp"),
        F.col("models"),
        F.struct("n_models", "best_score").alias("summary"),
    )
    return grouped.select(*keys, F.to_json(document).alias("document"))


def write_report_json(best: DataFrame, path: str) -> None:
    best.select("model", "params", "f1_score").write.mode("overwrite").json(path)


def run_summary(spark: SparkSession, manifest: DataFrame, root: str, required: list[str]) -> DataFrame:
    """Per run and required artifact: status, size as text, duration of the run.

    ``manifest`` is the appended log with ``run_id`` and ``last_update_ts``. The
    required names are a short list, exploded beside each run.
    """
    found = discover_files(spark, root, "").groupBy("name").agg(F.sum("size").alias("size"))
    runs = manifest.groupBy("run_id").agg(
        F.min("last_update_ts").alias("started"), F.max("last_update_ts").alias("finished")
    )
    seconds = F.unix_timestamp("finished") - F.unix_timestamp("started")
    wanted = runs.select(
        "run_id",
        datetime_text("finished").alias("finished"),
        hours_minutes(seconds).alias("duration"),
        F.explode(F.lit(required)).alias("name"),
    )
    return artifact_check(wanted, found, ("run_id", "finished", "duration")).select(
        "run_id",
        "finished",
        "duration",
        "name",
        "status",
        file_size_text("size").alias("size_text"),
        human_bytes("size").alias("size_short"),
    )
