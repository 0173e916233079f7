"""Writers for split parts, final tables, matrices and the run manifest."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.scalars import json_text, quoted, sha1_10
from granary.operators.features import TrainingMatrix
from granary.operators.schema import SOURCE, schema_fingerprint
from granary.operators.split import TEST, TRAIN

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("inputs", T.ArrayType(T.StringType())),
        T.StructField("full_run", T.BooleanType()),
        T.StructField("sample_rows", T.IntegerType()),
        T.StructField("union_cols", T.StringType()),
        T.StructField("union_cols_hash", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("rows_written_train", T.LongType()),
        T.StructField("rows_written_test", T.LongType()),
        T.StructField("last_update_ts", T.TimestampType()),
    ]
)


def write_parts(
    df: DataFrame, path: str, source: Column | str = SOURCE, max_records: int = 5_000_000
) -> None:
    """One folder per split and source; a rerun replaces exactly the folders it writes.

    Spark brings the rows of a folder together and splits large ones again, so a
    source has few files, and a large one is written by many tasks.
    """
    keyed = df.withColumn("source_key", sha1_10(source)).hint("rebalance", "split", "source_key")
    (
        keyed.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", max_records)
        .partitionBy("split", "source_key")
        .parquet(path)
    )


def write_split(
    df: DataFrame, train_path: str, test_path: str, fmt: str = "parquet", split: str = "split"
) -> None:
    """Final train and test tables. Pass a written or cheap table: it is read twice."""
    for side, path in ((TRAIN, train_path), (TEST, test_path)):
        writer = df.where(F.col(split) == side).drop(split).write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", "true")
        writer.save(path)


def extend_split(
    held: DataFrame, new: DataFrame, train_path: str, test_path: str, source: str = SOURCE, split: str = "split"
) -> dict[str, str]:
    """Bring the final Parquet tables up to ``held``, whose latest rows are ``new``; what was done per side.

    A table that holds all older rows gets the new ones appended, "appended", or is left as it is where there
    are none, "kept". It holds them all when it has as many rows as ``held`` without ``new`` and none of a new
    source, since no row is ever appended twice. Otherwise, after an interrupted run, for a replaced source or
    when a column is new or has another type, the table is "written" anew. Row counts come from file footers.
    """
    done = {}
    for side, path in ((TRAIN, train_path), (TEST, test_path)):
        rows, added = (df.where(F.col(split) == side).drop(split) for df in (held, new))
        n_added = added.count()
        if not _is_older_part(rows, added, rows.count() - n_added, path, source):
            rows.write.mode("overwrite").parquet(path)
            done[side] = "written"
        elif n_added:
            columns = held.sparkSession.read.parquet(path).columns
            added.select(*map(quoted, columns)).write.mode("append").parquet(path)
            done[side] = "appended"
        else:
            done[side] = "kept"
    return done


def _is_older_part(rows: DataFrame, added: DataFrame, n_older: int, path: str, source: str) -> bool:
    """Whether the table at ``path`` has the columns of ``rows`` and holds them all but for ``added``."""
    try:
        table = rows.sparkSession.read.parquet(path)
    except AnalysisException:  # no table yet
        return False
    types = [{f.name: f.dataType for f in df.schema.fields} for df in (table, rows)]
    if types[0] != types[1] or table.count() != n_older:
        return False
    return table.join(added.select(source).distinct(), source, "left_semi").isEmpty()


def write_matrix(matrix: TrainingMatrix, path: str) -> None:
    """Features and label numbers, label index, and classes with feature names as one table each."""
    base = path.rstrip("/")
    matrix.data.write.mode("overwrite").parquet(f"{base}/data")
    if matrix.index is not None:
        matrix.index.write.mode("overwrite").parquet(f"{base}/labels")
    matrix.metadata().coalesce(1).write.mode("overwrite").parquet(f"{base}/metadata")


def write_manifest(spark: SparkSession, path: str, **state) -> None:
    """Append the state of a run; the latest row of a run is its state."""
    columns = state.pop("columns", None)
    if columns is not None:
        state["union_cols_hash"] = schema_fingerprint(columns)
    row = {f.name: state.get(f.name) for f in MANIFEST_SCHEMA.fields}
    one = spark.createDataFrame([row], MANIFEST_SCHEMA).withColumn(
        "last_update_ts", F.current_timestamp()
    )
    if columns is not None:
        one = one.withColumn("union_cols", json_text(F.lit(columns)))
    one.coalesce(1).write.mode("append").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Latest state per run."""
    log = spark.read.schema(MANIFEST_SCHEMA).parquet(path)
    fields = [f.name for f in MANIFEST_SCHEMA.fields if f.name != "run_id"]
    latest = log.groupBy("run_id").agg(F.max_by(F.struct(*fields), "last_update_ts").alias("s"))
    return latest.select("run_id", "s.*")


def write_completed(files: DataFrame, path: str, run_id: str) -> None:
    """Append one row per file that a run has processed: ``files`` holds (path, rows)."""
    rows = files.select(F.lit(run_id).alias("run_id"), "path", F.col("rows").cast("bigint").alias("rows"))
    rows.withColumn("completed_ts", F.current_timestamp()).write.mode("append").parquet(path)


def completed_files(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """``(run_id, path, rows, completed_ts)`` of the processed files, of one run or of all."""
    files = spark.read.schema("run_id string, path string, rows bigint, completed_ts timestamp").parquet(path)
    return files if run_id is None else files.where(F.col("run_id") == run_id)
