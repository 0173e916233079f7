"""Run metrics as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.scalars import quoted
from granary.operators.telemetry import ALERT_RAM, RUN, classify_pressure, followed_widths
from granary.plans.small import join_same_keys
from granary.session import written

STATE_SCHEMA = f"{RUN} string, state bigint, head array<double>, head_rows array<double>"
#: Run of the row that tells that a stream has ended.
END_OF_STREAM = "\0end of stream"


def stream_throughput(
    metrics: DataFrame, seconds: int = 5, slide: int = 1, late: str = "10 seconds"
) -> DataFrame:
    """Rows and rows per second in sliding windows; samples behind the watermark are dropped.

    Works on a stream (append mode: closed windows) and on a batch alike. The row of ``end_of_stream`` closes the
    windows that are open when a stream ends, and is in no window that is returned.
    """
    timed = metrics.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    span = F.window("ts", f"{seconds} seconds", f"{slide} seconds")
    rows = timed.groupBy(RUN, span.alias("w")).agg(F.sum("rows_processed").alias("rows"))
    # A condition on the run alone would move below the watermark, which then would not see the row.
    ended = F.col(RUN).eqNullSafe(F.lit(END_OF_STREAM)) & F.col("w.end").isNotNull()
    return rows.where(~ended).select(
        RUN,
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        F.col("rows").cast("bigint").alias("rows"),
        (F.col("rows") / F.lit(float(seconds))).alias("rows_per_second"),
    )


def end_of_stream(metrics: DataFrame, seconds: int = 5, late: str = "10 seconds") -> DataFrame:
    """One row like those of ``metrics`` (a batch of all or the last samples), so late that it closes all windows of ``seconds``."""
    last = metrics.agg((F.max(F.col("ts").cast("timestamp")) + F.expr(f"interval {2 * seconds} seconds") + F.expr(f"interval {late}")).alias("ts"))
    kinds = dict(metrics.dtypes)
    filled = {RUN: F.lit(END_OF_STREAM), "ts": F.col("ts")}
    return last.where("ts is not null").select(*[filled.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in metrics.columns])


def stream_adaptive_window(metrics: DataFrame, path: str, states: str, checkpoint: str):
    """Drive a stream of samples into a table of widths, ``(run_id, ts, seq, window_seconds)``; returns the finished query.

    Each micro-batch is followed as a log of its own, its runs cut into stretches over tasks, from the states that the
    batch before has left below ``states``: per run the width and the last seven samples. A batch that is run again
    after a failure starts from the same states and replaces its own folder. Samples of a run must arrive in order
    across batches.
    """

    def follow(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        slim = batch.select(
            F.col(RUN).cast("string").alias(RUN),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("seq").cast("bigint").alias("seq"),
            "throughput",
            "rows_processed",
        )
        slim = written(slim, "samples")
        before = spark.read.schema(STATE_SCHEMA).parquet(f"{states}/version={number - 1}") if number else None
        widths, after = followed_widths(slim, before)
        widths.withColumnRenamed("after", "window_seconds").write.mode("overwrite").parquet(f"{path}/batch={number}")
        if before is not None:
            seen = slim.select(RUN).distinct().withColumn("__seen", F.lit(True))
            rest = join_same_keys(before, seen, [RUN], "left").where(F.col("__seen").isNull()).drop("__seen")
            after = after.unionByName(rest)
        after.write.mode("overwrite").parquet(f"{states}/version={number}")

    query = metrics.writeStream.foreachBatch(follow).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stream_pressure_alerts(metrics: DataFrame, threshold: float = ALERT_RAM) -> DataFrame:
    """Samples under pressure with their level and step, and the memory alert flag."""
    classified = classify_pressure(metrics)
    return classified.where(F.col("level") != "normal").withColumn(
        "memory_alert", F.col("ram_percent") >= threshold
    )


def stream_running_stats(stream: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Count, mean and population std per column and label, kept up to date (complete mode)."""
    return stream.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(quoted(c)).alias(f"mean_{c}") for c in cols],
        *[F.stddev_pop(quoted(c)).alias(f"std_{c}") for c in cols],
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Drive a stream over all available input into a table; returns the finished query.

    Append goes to the file sink. Complete and update results replace the table's
    latest version, one folder per batch.
    """
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", path).outputMode("append")
    else:

        def replace(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

        writer = stream.writeStream.foreachBatch(replace).outputMode(mode)
    query = (
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def latest_version(spark, path: str) -> DataFrame:
    """Newest complete result that ``run_to_table`` has written."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("version").alias("v")).first()["v"]
    return spark.read.parquet(f"{path}/version={newest}")
