"""Small sides: read to the driver only up to a checked number of rows and bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.scalars import quoted

SMALL_ROWS, SMALL_BYTES = 20_000, 8 << 20


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: texts and other values of varying width as long as they are, the rest 8 each."""
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    parts = []
    for f in df.schema.fields:
        if isinstance(f.dataType, fixed):
            parts.append(F.lit(8))
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(quoted(f.name)), F.lit(0)) + 8)
        else:
            parts.append(F.octet_length(F.to_json(F.struct(quoted(f.name)))) + 8)
    return reduce(lambda a, b: a + b, parts, F.lit(0)).cast("long")


def small_rows(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES):
    """Rows of ``df`` when there are at most ``max_rows`` of at most ``max_bytes`` in all, else None.

    Rows are counted and measured where they are; of larger relations no more than that reaches the driver.
    """
    some = df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row"), row_bytes(df).alias("bytes")).limit(max_rows + 1)
    until = F.sum("bytes").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    summed = some.withColumn("at", F.monotonically_increasing_id()).withColumn("until", until)
    # The row that goes beyond the bound comes without its content.
    within = summed.where(F.col("until") - F.col("bytes") <= max_bytes)
    rows = [r["row"] for r in within.select(F.when(F.col("until") <= max_bytes, F.col("row")).alias("row")).collect()]
    return None if len(rows) > max_rows or any(r is None for r in rows) else rows


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> DataFrame:
    """A join side that is broadcast after its rows and bytes were checked.

    A small side is computed once and broadcast, so that the other side is never
    shuffled. A larger relation is returned as it is, and Spark joins the two
    sides by shuffle (with AQE's skew handling).
    """
    rows = small_rows(df, max_rows, max_bytes)
    if rows is None:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def join_same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on equally named keys where NULL equals NULL; keeps the left keys."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns]
    )
    condition = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        condition = test if condition is None else condition & test
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])
