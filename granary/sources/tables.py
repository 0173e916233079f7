"""CSV scans by column name, per-file samples, row counts and row sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.scalars import present, quoted
from granary.operators.schema import (
    LABEL,
    SOURCE,
    align_to_schema,
    cast_by_profile,
    check_case,
    infer_types,
    standardize_label,
    union_columns,
)
from granary.plans.ranks import head_per_group
from granary.sources.files import checked_headers, discover_files
from granary.sources.heads import first_rows, written_heads

# Row position of a scanned row: start of its block in the file, then a number
# that grows within the block.
POSITION = ("_block", "_row")

DEFAULT_ROW_BYTES = 512.0


def header_groups(headers: DataFrame) -> dict[tuple[str, ...], list[str]]:
    """Paths by header. One entry per file reaches the driver, as for any file scan."""
    per_file = headers.where(F.col("error").isNull()).groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("cols")
    )
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in per_file.toLocalIterator():
        groups.setdefault(tuple(c["name"] for c in row["cols"]), []).append(row["path"])
    return groups


def _scan_group(
    spark: SparkSession, header: tuple[str, ...], paths: list[str], multi_line: bool
) -> DataFrame:
    """Raw text of the files that share a header, with source path and position."""
    positional = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
    raw = (
        spark.read.schema(positional)
        .option("header", "true")
        .option("enforceSchema", "true")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", str(multi_line).lower())
        .csv(paths)
    )
    return raw.select(
        F.col("_metadata.file_path").alias(SOURCE),
        F.col("_metadata.file_block_start").alias(POSITION[0]),
        F.monotonically_increasing_id().alias(POSITION[1]),
        *[F.col(f"c{i}").alias(name) for i, name in enumerate(header)],
    )


def _aligned_scan(
    spark: SparkSession, header: tuple[str, ...], paths: list[str], columns: list[str], positions: bool, multi_line: bool
) -> DataFrame:
    """``_scan_group`` under the union schema; missing cells are NULL."""
    extra = [SOURCE, *(POSITION if positions else ())]
    part = align_to_schema(standardize_label(_scan_group(spark, header, paths, multi_line)), [*extra, *columns])
    return part.select(*extra, *[present(quoted(c)).alias(c) for c in columns])


def scan_csv(
    spark: SparkSession,
    root: str | list[str] | None = None,
    files: DataFrame | None = None,
    columns: list[str] | None = None,
    positions: bool = False,
    multi_line: bool = False,
    lenient: bool = False,
    headers: DataFrame | None = None,
) -> DataFrame:
    """All rows as text under the union schema, columns matched by name.

    Files are read once per distinct header, since a multi-file CSV read matches
    columns by position. Adds the source path, and with ``positions`` the row
    position that reproduces the order within a file. ``multi_line`` accepts line
    breaks inside quotes, at the price of one task per file. A file without a
    readable header is an error, or with ``lenient`` left out (``read_headers``
    tells which); ``headers`` passes a header table that is already there.
    """
    if headers is None:
        headers = checked_headers(discover_files(spark, root) if files is None else files, lenient)
    groups = header_groups(headers)
    if not groups:
        raise FileNotFoundError("no file with a readable header")
    columns = columns or union_columns(*[list(h) for h in groups])
    check_case(spark, columns)
    parts = [_aligned_scan(spark, h, sorted(paths), columns, positions, multi_line) for h, paths in sorted(groups.items())]
    return reduce(DataFrame.unionByName, parts)


def typed(
    df: DataFrame,
    types: dict[str, str] | None = None,
    keep: tuple[str, ...] = (),
    integers: str = "int64",
) -> DataFrame:
    """Scanned text columns cast by their inferred types; source, position and label stay.

    Types are decided over all rows in one pass, not per chunk. ``integers`` may
    ask for ``float64``, so that tables of several runs agree on their types.
    """
    fixed = {SOURCE, *POSITION, LABEL, *keep} & set(df.columns)
    texts = [c for c in df.columns if c not in fixed]
    if types is None:
        block = df.select(*[quoted(c) for c in texts])
        found = infer_types(block, nullable_integers=True).collect()
        types = {r["name"]: r["dtype"] for r in found}
    kinds = {c: integers if t == "int64" else t for c, t in types.items()}
    return cast_by_profile(df, kinds, skip=fixed, raw=False)


def sample_files(
    spark: SparkSession,
    root: str | list[str] | None = None,
    n: int = 10_000,
    files: DataFrame | None = None,
    positions: bool = False,
    headers: DataFrame | None = None,
) -> DataFrame:
    """First ``n`` rows of each file, as a written table; a file is read only as far as that.

    Rows come from the beginnings of the files, by Spark's CSV reader as in a full scan, one task per file.
    """
    if headers is None:
        headers = checked_headers(discover_files(spark, root) if files is None else files)
    groups = header_groups(headers)
    if not groups:
        raise FileNotFoundError("no file with a readable header")
    columns = union_columns(*[list(h) for h in groups])
    check_case(spark, columns)
    scans = [
        lambda header=header, path=path: _aligned_scan(spark, header, [path], columns, True, False)
        for header, paths in sorted(groups.items())
        for path in sorted(paths)
    ]
    first = written_heads(spark, scans, n, "sample")
    return first if positions else first.drop(*POSITION)


def scan_sample(df: DataFrame, order: list[str], n: int = 10_000, source: str = SOURCE) -> DataFrame:
    """First ``n`` rows per source of a table, by its order columns."""
    return head_per_group(df, [source], order, n)


def count_rows(df: DataFrame, cap: int = 2_000_000, by: list[str] | None = None) -> DataFrame:
    """``rows``: number of rows, at most ``cap`` (per group of ``by``)."""
    counted = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("rows"))
    return counted.withColumn("rows", F.least("rows", F.lit(cap)).cast("bigint"))


def row_size_profile(
    df: DataFrame, sample_rows: int = 2000, total_bytes: int | None = None, order: list[str] | None = None
) -> DataFrame:
    """Mean bytes per row as CSV text over the first rows; estimated rows of a file of that size.

    The first rows of a table of files are those at the beginning of its first files, of any other those of
    ``order``, by default of all columns from left to right, so that every run reads the same ones.
    """
    width = F.octet_length(F.to_csv(F.struct(*[quoted(c) for c in df.columns])))
    first = first_rows(df, sample_rows) if order is None else None
    if first is None:
        first = df.orderBy(*[quoted(c) for c in order or df.columns]).limit(sample_rows)
    profile = first.agg(
        F.count(F.lit(1)).alias("sampled_rows"),
        F.coalesce(F.avg(width), F.lit(DEFAULT_ROW_BYTES)).alias("bytes_per_row"),
    )
    if total_bytes is None:
        return profile
    rows = F.lit(int(total_bytes)) / F.greatest("bytes_per_row", F.lit(1.0))
    return profile.withColumn("estimated_rows", F.floor(rows).cast("bigint"))


def scan_dataset_artifact(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Data and one-row metadata of a written matrix; raises if a part is missing."""
    data = spark.read.parquet(f"{path.rstrip('/')}/data")
    meta = spark.read.parquet(f"{path.rstrip('/')}/metadata")
    lacking = {"features", "label_idx"} - set(data.columns)
    lacking |= {"classes", "numeric_cols"} - set(meta.columns)
    if lacking:
        raise ValueError(f"matrix at {path} lacks {sorted(lacking)}")
    return data, meta

