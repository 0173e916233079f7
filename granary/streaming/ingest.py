"""Streaming ingestion of files and the streaming ratio split.

Both write one folder per micro-batch and overwrite it when a batch is replayed,
which together with the checkpoint makes their output exactly-once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.scalars import has_suffix
from granary.operators.clean import sanitize
from granary.operators.schema import LABEL, SOURCE, align_to_schema
from granary.operators.split import TEST, TRAIN, TRAIN_RATIO, goes_to_train
from granary.plans.ranks import add_rank
from granary.plans.small import join_same_keys, small_side
from granary.session import written
from granary.sources.files import checked_headers
from granary.sources.tables import scan_csv, typed

FILE_LISTING = "path string, modificationTime timestamp, length bigint, content binary"


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/batch={batch_id}"


def stream_consolidate(
    spark: SparkSession,
    root: str,
    out: str,
    checkpoint: str,
    columns: list[str],
    types: dict[str, str],
    files_per_batch: int = 1000,
    lenient: bool = False,
):
    """Ingest new CSV files below ``root`` as they arrive; returns the finished query.

    A file without a readable header fails its batch, which is tried again by the
    next start. With ``lenient`` the file is left out for good and listed below
    ``<out>_unreadable`` (see ``read_unreadable``).

    The stream carries file names only, at most ``files_per_batch`` at a time.
    Each batch reads its files by header, aligns them to the union schema and
    sanitizes them, so files with differing headers are matched by name.
    """
    listing = (
        spark.readStream.format("binaryFile")
        .schema(FILE_LISTING)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
        .select("path")
        .where(has_suffix("path", ".csv"))
    )

    def ingest(names: DataFrame, batch_id: int) -> None:
        paths = [r["path"] for r in names.collect()]  # at most files_per_batch names
        if not paths:
            return
        files = spark.createDataFrame([(p,) for p in paths], "path string")
        headers = checked_headers(files, lenient)
        bad = headers.where(F.col("error").isNotNull()).select("path", "error")
        if lenient and not bad.isEmpty():
            bad.write.mode("overwrite").parquet(batch_folder(f"{out.rstrip('/')}_unreadable", batch_id))
        if headers.where(F.col("error").isNull()).isEmpty():
            return
        rows = typed(scan_csv(spark, headers=headers, columns=columns), types)
        clean = sanitize(rows, [SOURCE, *columns], narrow=False)
        clean.write.mode("overwrite").parquet(batch_folder(out, batch_id))

    return (
        listing.writeStream.foreachBatch(ingest)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_unreadable(spark: SparkSession, out: str) -> DataFrame:
    """``(path, error)`` of the files that a lenient ingestion has left out so far."""
    try:
        return spark.read.parquet(f"{out.rstrip('/')}_unreadable").select("path", "error")
    except AnalysisException:  # none
        return spark.createDataFrame([], "path string, error string")


def _counts_before(spark: SparkSession, path: str, batch_id: int, schema) -> DataFrame:
    """Rows per group in all earlier batches, read from the running totals of the newest one."""
    keys = [f.name for f in schema.fields if f.name not in ("batch", "n")]
    try:
        totals = spark.read.schema(schema).parquet(path).where(F.col("batch") < batch_id)
        newest = totals.agg(F.max("batch")).first()[0]
        totals = totals.where(F.col("batch") == F.lit(newest))
    except AnalysisException:  # first batch
        totals = spark.createDataFrame([], schema)
    return totals.select(*keys, F.col("n").alias("__seen"))


def split_batch(
    batch: DataFrame,
    batch_id: int,
    order: list[str],
    out: str,
    by: tuple[str, ...] = (SOURCE, LABEL),
    ratio: float = TRAIN_RATIO,
) -> None:
    """Split one micro-batch, continuing the row numbers of the batches before it.

    Within the batch, rows are ranked per group by slices, so a hot label is
    shared by many tasks. The state is one row per group and batch.
    """
    spark = batch.sparkSession
    rows_path, counts_path = f"{out}/rows", f"{out}/counts"
    counts = batch.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    with_batch = counts.select(*by, "n", F.lit(batch_id).cast("bigint").alias("batch"))
    seen = _counts_before(spark, counts_path, batch_id, with_batch.schema)
    ranked = join_same_keys(add_rank(batch, list(by), order, "__rank"), small_side(seen), list(by), "left")
    place = F.col("__rank") + F.coalesce("__seen", F.lit(0))
    side = F.when(goes_to_train(place, ratio), TRAIN).otherwise(TEST)
    ranked.withColumn("split", side).drop("__rank", "__seen").write.mode("overwrite").parquet(
        batch_folder(rows_path, batch_id)
    )
    # Running totals: the next batch reads this folder alone. A replay overwrites its own only.
    totals = seen.select(*by, F.col("__seen").alias("n")).unionByName(counts).groupBy(*by).agg(F.sum("n").alias("n"))
    totals.write.mode("overwrite").parquet(batch_folder(counts_path, batch_id))


def stream_ratio_split(
    stream: DataFrame,
    order: list[str],
    out: str,
    checkpoint: str,
    by: tuple[str, ...] = (SOURCE, LABEL),
    ratio: float = TRAIN_RATIO,
):
    """The ratio split over a stream whose batches arrive in order; returns the query."""

    def split(batch: DataFrame, batch_id: int) -> None:
        # Read for bounds, counts and rows; in the shared folder, where a lost executor loses nothing.
        split_batch(written(batch, "batch"), batch_id, order, out, by, ratio)

    return (
        stream.writeStream.foreachBatch(split)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_split(spark: SparkSession, out: str) -> DataFrame:
    """All rows that a streaming split has written so far."""
    return spark.read.parquet(f"{out}/rows").drop("batch")


def read_ingested(spark: SparkSession, out: str, columns: list[str]) -> DataFrame:
    """All rows that ``stream_consolidate`` has written so far."""
    return align_to_schema(spark.read.parquet(out), [SOURCE, *columns])
