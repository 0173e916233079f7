"""Streaming queries: driven over the given tables into written tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.catalog.inputs import LEVEL, METRICS, csv_export, folder_of, metrics, r6, table
from granary.catalog.shapes import ORACLES as SHAPE_ORACLES
from granary.catalog.splits import ORACLES as SPLIT_ORACLES
from granary.catalog.telemetry import ORACLES as TELEMETRY_ORACLES
from granary.session import shared_dir
from granary.streaming import ingest as J
from granary.streaming import telemetry as ST

def _arrive(spark, piece, schema, start, path: str) -> None:
    """Let ``piece`` arrive in a folder, ``start`` the stream over it anew from its checkpoint, and wait until it has caught up."""
    piece.write.mode("append").parquet(path)
    start(spark.readStream.schema(schema).parquet(path)).awaitTermination()


def _arriving(spark, df, order: str, start, pieces: int = 3, path: str | None = None) -> None:
    """Let ``df`` arrive in consecutive pieces of its order."""
    path = path or shared_dir(spark, "arrivals")
    ends = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    step = (ends["hi"] - ends["lo"]) // pieces + 1
    for i in range(pieces):
        low = ends["lo"] + i * step
        _arrive(spark, df.where((F.col(order) >= low) & (F.col(order) < low + step)), df.schema, start, path)


def _run_metrics(spark, sf, name: str, build, mode: str = "append") -> str:
    """Run a metrics stream into a table; returns the table's path."""
    path, state = shared_dir(spark, name), shared_dir(spark, f"{name}-state")
    samples = metrics(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    _arriving(
        spark, samples, "seq", lambda stream: ST.run_to_table(build(stream), path, state, mode)
    )
    return path


UNION = [
    "c_acctbal", "c_custkey", "c_name", "c_nationkey", "p_brand", "p_name", "p_partkey",
    "p_retailprice", "p_size", "p_type", "s_acctbal", "s_nationkey", "s_suppkey", "Label",
]
UNION_TYPES = {
    "c_acctbal": "float64", "c_custkey": "int64", "c_nationkey": "int64", "p_partkey": "int64",
    "p_retailprice": "float64", "p_size": "int64", "s_acctbal": "float64", "s_nationkey": "int64",
    "s_suppkey": "int64",
}


def consolidated(spark, sf):
    out, state = shared_dir(spark, "ingested"), shared_dir(spark, "ingest-state")
    query = J.stream_consolidate(
        spark, csv_export(spark, sf), out, state, UNION, UNION_TYPES, files_per_batch=2
    )
    query.awaitTermination()
    rows = J.read_ingested(spark, out, UNION)
    return rows.withColumn("source", folder_of("source"))


def split(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    out, state = shared_dir(spark, "split"), shared_dir(spark, "split-state")
    _arriving(
        spark, events, "event_id",
        lambda stream: J.stream_ratio_split(stream, ["event_id"], out, state, ("event_type",), 0.6),
    )
    return J.read_split(spark, out).select("event_id", "event_type", "split")


def throughput(spark, sf):
    """All sliding windows of the log; a last row closes those that are open when it ends."""
    path, state, arrivals = (shared_dir(spark, f"throughput{x}") for x in ("", "-state", "-arrivals"))
    samples = metrics(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    build = lambda stream: ST.stream_throughput(stream, 7200, 3600, "1 hour")
    start = lambda stream: ST.run_to_table(build(stream), path, state)
    _arriving(spark, samples, "seq", start, path=arrivals)
    # One row moves the watermark on, and with the next one the windows behind it are written.
    for _ in range(2):
        _arrive(spark, ST.end_of_stream(samples, 7200, "1 hour"), samples.schema, start, arrivals)
    return spark.read.parquet(path).select(
        "run_id", F.unix_seconds("window_start").alias("window_start"), "rows",
        r6("rows_per_second").alias("rows_per_second"),
    )


def widths(spark, sf):
    path, states, checkpoint = (shared_dir(spark, f"widths{x}") for x in ("", "-states", "-checkpoint"))
    samples = metrics(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    _arriving(spark, samples, "seq", lambda stream: ST.stream_adaptive_window(stream, path, states, checkpoint))
    return spark.read.parquet(path).select("run_id", "seq", "window_seconds")


def alerts(spark, sf):
    path = _run_metrics(spark, sf, "alerts", ST.stream_pressure_alerts)
    return spark.read.parquet(path).select("run_id", "seq", "level", "memory_alert")


def statistics(spark, sf):
    path = _run_metrics(
        spark, sf, "statistics",
        lambda stream: ST.stream_running_stats(stream, ["throughput", "ram_percent"], "run_id"),
        "complete",
    )
    rows = ST.latest_version(spark, path)
    return rows.select(
        "label", "rows",
        *[r6(c).alias(c) for c in rows.columns if c.startswith(("mean_", "std_"))],
    )


QUERIES = {
    "d6_streaming_ratio_split": split,
    "j1_stream_consolidate": consolidated,
    "j3_stream_throughput": throughput,
    "j4_stream_adaptive_window": widths,
    "j5_stream_pressure_alerts": alerts,
    "j6_stream_running_stats": statistics,
}

ORACLES = {
    "d6_streaming_ratio_split": SPLIT_ORACLES["d1_ratio_split"],
    "j1_stream_consolidate": f"""select * from ({SHAPE_ORACLES["a3_scan_csv"]}) where "Label" is not null""",
    "j3_stream_throughput": f"""with {METRICS}, t as (select *, epoch_us(ts) // 3600000000 as h from m),
      s as (select run_id, rows_processed, unnest([h - 1, h]) as h from t)
      select run_id, (h * 3600)::bigint as window_start, sum(rows_processed)::bigint as rows,
        round(sum(rows_processed) / 7200.0::double, 6) as rows_per_second from s group by 1, 2""",
    "j4_stream_adaptive_window": TELEMETRY_ORACLES["i3_adaptive_window"],
    "j5_stream_pressure_alerts": f"""with {METRICS}, l as (select *, {LEVEL} as level from m)
      select run_id, seq, level, ram_percent >= 90 as memory_alert from l where level <> 'normal'""",
    "j6_stream_running_stats": f"""with {METRICS} select run_id as label, count(*) as rows,
      round(avg(throughput), 6) as mean_throughput, round(avg(ram_percent), 6) as mean_ram_percent,
      round(stddev_pop(throughput), 6) as std_throughput, round(stddev_pop(ram_percent), 6) as std_ram_percent
      from m group by 1""",
}
