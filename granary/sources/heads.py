"""First lines and first rows of files, read from their beginnings only.

Headers are read through the Hadoop file systems of the session, a few bytes per file. Rows come from
Spark's own readers, planned with one partition per file and a limit on each: the reader of a partition
stops with its limit, whatever the size of the file.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import AbstractContextManager
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.scalars import quoted
from granary.session import settings, shared_dir

#: More bytes than a file has: none is split, and after one file a partition is full.
BEYOND_FILES = 1 << 50
#: Bytes of a line that may be a header, bytes per read, files read at a time.
LONGEST_LINE, READ_BYTES, READERS = 16 << 20, 16 << 10, 32
#: Files per job of limited scans, and jobs at a time.
FILES_PER_JOB, JOBS = 32, 4


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a text file that is not empty, without a byte order mark; None if there is none."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    file = hadoop.fs.Path(path)
    stream = file.getFileSystem(conf).open(file)
    try:
        codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(file)
        lines = hadoop.util.LineReader(stream if codec is None else codec.createInputStream(stream), READ_BYTES)
        line = hadoop.io.Text()
        while taken := lines.readLine(line, LONGEST_LINE, LONGEST_LINE):
            if taken >= LONGEST_LINE:
                raise ValueError(f"the first line of {path} has more than {LONGEST_LINE} bytes")
            if text := line.toString().removeprefix("\ufeff"):
                return text
        return None
    finally:
        stream.close()


def first_lines(spark: SparkSession, paths: list[str], lenient: bool = False) -> list[str | None]:
    """``first_line`` of each path; with ``lenient`` None for a file that cannot be read."""

    def read(path: str) -> str | None:
        try:
            return first_line(spark, path)
        except Py4JJavaError:
            if lenient:
                return None
            raise

    with ThreadPoolExecutor(READERS) as pool:
        return list(pool.map(read, paths))


def one_file_per_partition(spark: SparkSession) -> AbstractContextManager:
    return settings(spark, {"spark.sql.files.maxPartitionBytes": BEYOND_FILES, "spark.sql.files.openCostInBytes": BEYOND_FILES})


def written_heads(spark: SparkSession, scans: list[Callable[[], DataFrame]], n: int, tag: str) -> DataFrame:
    """The first ``n`` rows of each of ``scans``, which make a scan of one file with projections only, as one table."""
    folder = shared_dir(spark, tag)

    def write(at: int) -> None:
        heads = [scan().limit(n) for scan in scans[at : at + FILES_PER_JOB]]
        reduce(DataFrame.unionByName, heads).write.parquet(f"{folder}/part={at}")

    with one_file_per_partition(spark), ThreadPoolExecutor(JOBS) as pool:
        list(pool.map(write, range(0, len(scans), FILES_PER_JOB)))
    schema = scans[0]().schema
    return spark.read.schema(schema).parquet(*[f"{folder}/part={at}" for at in range(0, len(scans), FILES_PER_JOB)])


def first_rows(table: DataFrame, n: int) -> DataFrame | None:
    """The first ``n`` rows of a table of files: files by path, rows as they lie in them; None if it is of none.

    One file is looked at first, then eight times as many until they hold ``n`` rows.
    """
    paths = sorted(table.inputFiles())
    if not paths:
        return None
    path, looked_at = F.col("_metadata.file_path"), 1
    located = table.select(path.alias("__path"), F.monotonically_increasing_id().alias("__at"), *[quoted(c) for c in table.columns])
    # A listing writes "file:///a" where a scan has "file:/a".
    forms = [(p, re.sub(r"^([\w+.-]+):///", r"\1:/", p)) for p in paths]
    scans = [lambda own=own: located.where(path.isin(*own)) for own in forms]
    while True:
        heads = written_heads(table.sparkSession, scans[:looked_at], n, "first-rows")
        if looked_at >= len(paths) or heads.count() >= n:
            return heads.orderBy("__path", "__at").limit(n).drop("__path", "__at")
        looked_at *= 8
