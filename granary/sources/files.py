"""Finding files and reading their headers as distributed jobs."""

from __future__ import annotations

import csv
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.scalars import basename
from granary.session import written
from granary.sources.heads import first_lines

HEADER_SCHEMA = "path string, pos bigint, name string, error string"


def _any_case_glob(ext: str) -> str:
    """``.csv`` as ``*.[cC][sS][vV]``."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)


def discover_files(spark: SparkSession, root: str | list[str], ext: str = ".csv") -> DataFrame:
    """``(path, name, size, modified)`` of all files below ``root``, any case of the extension.

    Only file listings are read, no contents. Files of zero bytes are not listed.
    Raises when nothing matches.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _any_case_glob(ext))
        .load(root)
        .select(
            "path",
            basename("path").alias("name"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("modified"),
        )
    )
    if files.limit(1).count() == 0:
        raise FileNotFoundError(f"no {ext} files below {root}")
    return files.orderBy("path")


def plain_path(file_path: Column | str) -> Column:
    """``_metadata.file_path`` as file listings name it: without percent signs for blanks and the like."""
    c = F.col(file_path) if isinstance(file_path, str) else file_path
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def parse_header(text_lines: Iterator[str]) -> list[str]:
    """Names of the first non-blank CSV record; empty and repeated ones made unique.

    An empty name becomes ``Unnamed: i``; a repeated one gets ``.1``, ``.2`` ...
    """
    record = next((r for r in csv.reader(text_lines) if r), None)
    if record is None:
        raise ValueError("no header")
    names: list[str] = []
    taken: set[str] = set()
    counts: dict[str, int] = {}
    for i, raw in enumerate(record):
        base = raw if raw else f"Unnamed: {i}"
        name = base
        while name in taken:
            counts[base] = counts.get(base, 0) + 1
            name = f"{base}.{counts[base]}"
        taken.add(name)
        names.append(name)
    return names


def read_headers(files: DataFrame, lenient: bool = False) -> DataFrame:
    """``(path, pos, name, error)``: names of each file's first line that is not empty, as a written table.

    The files are read only as far as that line, on any file system of the session. A file without such a
    line has one row with an error. A file that cannot be read is an error, or with ``lenient`` has a row like
    one without a header. As with every file scan, the driver holds one entry per file, and besides each
    different header once.
    """
    spark = files.sparkSession
    paths = [r["path"] for r in files.select("path").distinct().toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], HEADER_SCHEMA)
    numbers: dict[str | None, int] = {}
    of_file = [(path, numbers.setdefault(line, len(numbers))) for path, line in zip(paths, first_lines(spark, paths, lenient), strict=True)]
    names = [(i, pos, name, None) for line, i in numbers.items() if line is not None for pos, name in enumerate(parse_header(iter([line])), 1)]
    names += [(i, None, None, "no header") for line, i in numbers.items() if line is None]
    headers = spark.createDataFrame(names, "_header int, pos bigint, name string, error string")
    rows = spark.createDataFrame(of_file, "path string, _header int").join(headers, "_header")
    return written(rows.select("path", "pos", "name", "error"), "headers")


def checked_headers(files: DataFrame, lenient: bool = False) -> DataFrame:
    """``read_headers`` as a written table; unless ``lenient`` a file without header is an error."""
    headers = read_headers(files, lenient)
    if not lenient:
        bad = headers.where(F.col("error").isNotNull()).limit(6).collect()
        if bad:
            names = ", ".join(r["path"] for r in bad[:5]) + (" and more" if len(bad) > 5 else "")
            raise ValueError(f"files without a readable header: {names}; pass lenient=True to leave them out")
    return headers


def header_inventory(
    spark: SparkSession, root: str | list[str], ext: str = ".csv", lenient: bool = False
) -> DataFrame:
    """``(path, pos, name)`` of every file below ``root``; see ``checked_headers``."""
    headers = checked_headers(discover_files(spark, root, ext), lenient)
    return headers.where(F.col("error").isNull()).drop("error")


def unreadable_files(spark: SparkSession, root: str | list[str], ext: str = ".csv") -> DataFrame:
    """``(path, error)`` of the files that a lenient scan leaves out."""
    headers = read_headers(discover_files(spark, root, ext), lenient=True)
    return headers.where(F.col("error").isNotNull()).select("path", "error")
