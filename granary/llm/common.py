"""Shared pieces: the table reader, words and lines as columns, document keys, running totals."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ``[\x20\x09-\x0D]``, the white space of every contract here.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Names of the key columns; a leading "_k" keeps them apart from columns of the input.
KEY = ["_k_null", "_k_id", "_k_text"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(vocabulary: str) -> str:
    """A vocabulary file: an absolute path as it is, a bare name in the installed folder of public tokenizers."""
    if os.path.isabs(vocabulary):
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with key columns that can be joined by plain equality.

    A document is a pair of id and text: rows that repeat both are one document, rows that share
    an id but not the text are two. A null id is an id of its own.
    """
    return docs.withColumns(
        {
            "_k_null": F.col("doc_id").isNull(),
            "_k_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
            "_k_text": F.xxhash64(F.col("text")),
        }
    )


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space; 0 for null and empty texts."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def running_start(df: DataFrame, group: list[str], part: str, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running total of ``value`` in each group along (``part``, ``order``).

    Windows run inside a part; one total per part carries the sum over to the next. With about as
    many parts as a part has rows, neither window grows beyond the root of the group. ``df`` is
    read twice, so it should be a written table.
    """
    inside = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, part).agg(F.sum(value).alias("_total"))
    totals = totals.withColumn("_base", F.coalesce(F.sum("_total").over(across), F.lit(0))).drop("_total")
    inner = df.withColumn("_inner", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        inner.join(totals, [*group, part])
        .withColumn(out, F.col("_base") + F.col("_inner"))
        .drop("_base", "_inner")
    )


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most ``rows`` rows, between Spark and Python and out of ORC files, for the jobs started inside."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.orc.columnarReaderBatchSize")
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
