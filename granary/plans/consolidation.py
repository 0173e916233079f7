"""Consolidation as one plan: scan or merge, sanitize, split, write, build the matrix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.scalars import quoted, sha1_10
from granary.operators.clean import sanitize
from granary.operators.features import build_training_matrix
from granary.operators.relations import pending_inputs
from granary.operators.schema import LABEL, SOURCE, numeric_columns
from granary.operators.split import TRAIN, TRAIN_RATIO, random_split, ratio_split, split_summary
from granary.session import settings, written
from granary.sinks.tables import (
    completed_files,
    extend_split,
    write_completed,
    write_manifest,
    write_matrix,
    write_parts,
)
from granary.sources.files import checked_headers, discover_files, plain_path
from granary.sources.tables import POSITION, sample_files, scan_csv, typed


@dataclass
class ConsolidationResult:
    parts: str
    train: str
    test: str
    matrix: str | None
    summary: DataFrame
    unreadable: DataFrame  # path, error of the files that this run left out


def consolidate_files(
    spark: SparkSession,
    files: DataFrame,
    ratio: float = TRAIN_RATIO,
    narrow: bool = False,
    sample_rows: int | None = None,
    types: dict[str, str] | None = None,
    lenient: bool = False,
    headers: DataFrame | None = None,
) -> DataFrame:
    """Rows of all files, cleaned and split per file and label in file order.

    The block of a row serves as its slice, so no order statistics are needed.
    Column types are inferred over all rows unless ``types`` names them; numbers
    are doubles, so that the parts of several runs fit together. ``sample_rows``
    takes only the first rows of each file. A file without a readable header is an
    error, or with ``lenient`` left out.
    """
    headers = checked_headers(files, lenient) if headers is None else headers
    if sample_rows is None:
        raw = scan_csv(spark, headers=headers, positions=True)
    else:
        raw = sample_files(spark, n=sample_rows, headers=headers, positions=True)
    # Stored once: the split reads it twice, and the row positions stay what they are.
    clean = written(_sanitize_features(typed(raw, types, integers="float64"), narrow), "clean")
    if LABEL not in clean.columns:
        place = F.concat_ws(":", SOURCE, *[F.col(p).cast("string") for p in POSITION])
        keyed = clean.withColumn("__key", place)
        return random_split(keyed, "__key", ratio).drop("__key", *POSITION)
    order = list(POSITION)
    return ratio_split(clean, order, ratio, (SOURCE, LABEL), slices=order[:1]).drop(*POSITION)


def _sanitize_features(df: DataFrame, narrow: bool) -> DataFrame:
    """Clean all columns but source and position."""
    features = [c for c in df.columns if c not in (SOURCE, *POSITION)]
    # Inside a struct the position is no numeric column.
    at = F.struct(*[F.col(c) for c in POSITION]).alias("__at")
    clean = sanitize(df.select(SOURCE, at, *[quoted(c) for c in features]), narrow=narrow)
    return clean.select(
        SOURCE,
        *[F.col(f"__at.{p}").alias(p) for p in POSITION],
        *[quoted(c) for c in clean.columns if c not in (SOURCE, "__at")],
    )


def run_consolidation(
    spark: SparkSession,
    inputs: str | list[str],
    out: str,
    ratio: float = TRAIN_RATIO,
    sample_rows: int | None = None,
    run_id: str = "run",
    lenient: bool = False,
) -> ConsolidationResult:
    """Discover, merge, clean, split, write parts, final tables and the matrix.

    A rerun skips the files that were processed, and replaces the parts of the
    others; part folders are committed as a whole. A file counts as processed when
    its rows are in the parts, or its header was read and there are none. Files
    without a readable header are an error; with ``lenient`` they are left out,
    listed in the result, and tried again by the next run.

    Final tables get the rows of new files appended (see ``extend_split``); the
    matrix is scaled over all rows and built anew.
    """
    base = out.rstrip("/")
    manifest_path, completed_path = f"{base}/manifest", f"{base}/completed_files"
    files = discover_files(spark, inputs)
    try:
        todo = pending_inputs(files, completed_files(spark, completed_path, run_id).select("path"))
    except AnalysisException:  # nothing processed yet
        todo = files
    parts = f"{base}/parts"
    headers = checked_headers(todo, lenient)
    readable = headers.where(F.col("error").isNull()).select("path").distinct()
    # As a file listing names them, so that the folders of new files are known beforehand.
    keys = [r["key"] for r in readable.select(sha1_10("path").alias("key")).collect()]
    if keys:
        rows = consolidate_files(spark, todo, ratio, sample_rows=sample_rows, headers=headers)
        write_parts(rows, parts, plain_path(SOURCE))
    # A key of digits alone stays a text.
    with settings(spark, {"spark.sql.sources.partitionColumnTypeInference.enabled": "false"}):
        held = spark.read.option("mergeSchema", "true").parquet(parts)
    new = held.where(F.col("source_key").isin(keys)).drop("source_key")
    held = held.drop("source_key")
    if keys:
        per_file = new.groupBy(plain_path(SOURCE).alias("found")).agg(F.count(F.lit(1)).alias("rows"))
        done = readable.join(per_file, F.col("path") == F.col("found"), "left")
        write_completed(done.select("path", F.coalesce("rows", F.lit(0)).alias("rows")), completed_path, run_id)
    summary = split_summary(held)
    counts = held.groupBy("split").count().collect()
    rows_by_side = {r["split"]: r["count"] for r in counts}
    extend_split(held, new, f"{base}/train", f"{base}/test")
    train = spark.read.parquet(f"{base}/train")
    matrix_path = None
    features = numeric_columns(train.drop(SOURCE), texts=False)
    if LABEL in train.columns and features:  # otherwise there is no matrix to build
        matrix_path = f"{base}/matrix"
        write_matrix(build_training_matrix(train, cols=features), matrix_path)
    write_manifest(
        spark,
        manifest_path,
        run_id=run_id,
        inputs=[inputs] if isinstance(inputs, str) else list(inputs),
        full_run=sample_rows is None,
        sample_rows=sample_rows,
        columns=[c for c in train.columns if c != SOURCE],
        stage="done",
        rows_written_train=rows_by_side.get(TRAIN, 0),
        rows_written_test=sum(n for side, n in rows_by_side.items() if side != TRAIN),
    )
    unreadable = headers.where(F.col("error").isNotNull()).select("path", "error")
    return ConsolidationResult(parts, f"{base}/train", f"{base}/test", matrix_path, summary, unreadable)
