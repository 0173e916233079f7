"""Exact ranks and exact quotas per group without one task per group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.plans.slices import PART, add_parts, add_slices, before, part_window, with_carry
from granary.plans.small import join_same_keys, small_rows, small_side
from granary.session import written

# Hash slices: leading hex digits of a hash split any group evenly; as many are added at a
# time until the slice in which a quota ends has no more than this many rows to rank.
HASH_DIGITS = 3
RANKED_ROWS = 100_000


def add_rank(
    df: DataFrame, by: list[str], order: list[str], out: str = "rank", slices: list[str] | None = None
) -> DataFrame:
    """``row_number() over (partition by by order by order)`` with hot groups split.

    Rows are numbered within (group, slice); the row counts of the group's
    earlier slices are added. The big side moves once, hashed by (group, slice).
    ``slices`` names existing columns that never decrease along ``order``.
    """
    parted = add_parts(df, by, order, slices)
    local = parted.withColumn("__local", F.row_number().over(part_window(order)))
    carried = with_carry(
        local,
        {"__count": F.count(F.lit(1))},
        {"__ahead": lambda w: F.coalesce(F.sum("__count").over(before(w)), F.lit(0))},
    )
    ranked = carried.withColumn(out, F.col("__local") + F.col("__ahead"))
    return ranked.drop("__local", "__ahead", PART)


def quota_thresholds(
    df: DataFrame,
    by: list[str],
    order: list[str],
    slices: list[str],
    quota: Callable[[Column], Column],
    out: str = "threshold",
) -> DataFrame:
    """Per group, the order columns of its ``quota(n)``-th row, as one struct.

    Slice counts locate the slice in which the quota runs out; only that slice
    is ranked. Groups with quota 0 have no row.
    """
    per_slice = df.groupBy(*by, *slices).agg(F.count(F.lit(1)).alias("__count"))
    along = Window.partitionBy(*by).orderBy(*slices)
    group = Window.partitionBy(*by)
    counted = per_slice.select(
        *by,
        *slices,
        "__count",
        F.coalesce(F.sum("__count").over(before(along)), F.lit(0)).alias("__ahead"),
        F.sum("__count").over(group).alias("__total"),
    )
    total = F.col("__total")
    target = F.least(total, quota(total).cast("bigint"))
    boundary = counted.select(
        *by, *slices, (target - F.col("__ahead")).alias("__need"), "__count"
    ).where((F.col("__need") > 0) & (F.col("__need") <= F.col("__count")))
    edge_rows = join_same_keys(
        df.select(*dict.fromkeys([*by, *slices, *order])),
        small_side(boundary.drop("__count")),
        [*by, *slices],
    )
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return (
        edge_rows.withColumn("__rank", rank)
        .where(F.col("__rank") == F.col("__need"))
        .select(*by, F.struct(*order).alias(out))
    )


def quota_edges(df: DataFrame, by: list[str], hashed: str, quota: Callable[[Column], Column]) -> tuple[DataFrame, int]:
    """Per group the hash prefix in which its quota ends; and the length of the prefixes.

    ``__need`` rows of the ``__count`` rows with that prefix are still within the
    quota. Prefixes get longer, and the rows that share them fewer, until none has
    more than ``RANKED_ROWS``. Groups with quota 0 have no row.
    """
    digits, edges, rows = 0, None, df
    while True:
        digits += HASH_DIGITS
        counts = rows.groupBy(*by, F.substring(hashed, 1, digits).alias("__prefix")).agg(F.count(F.lit(1)).alias("__count"))
        group = Window.partitionBy(*by)
        counts = counts.withColumn("__before", F.coalesce(F.sum("__count").over(before(group.orderBy("__prefix"))), F.lit(0)))
        if edges is None:
            total = F.sum("__count").over(group)
            counts = counts.withColumn("__target", F.least(total, quota(total).cast("bigint")))
        else:
            targets = edges.select(*by, F.col("__need").alias("__target"))
            counts = join_same_keys(counts, targets, by)
        need = F.col("__target") - F.col("__before")
        found = counts.withColumn("__need", need).where((F.col("__need") > 0) & (F.col("__need") <= F.col("__count")))
        found = found.select(*by, "__prefix", "__need", "__count")
        known = small_rows(found)
        if known is None:
            edges = written(found, "quota-edges")
            largest = edges.agg(F.max("__count")).first()[0]
        else:
            edges = F.broadcast(df.sparkSession.createDataFrame(known, found.schema))
            largest = max([r["__count"] for r in known], default=0)
        if largest <= RANKED_ROWS or digits >= 32:
            return edges, digits
        rows = edge_rows(df, by, hashed, edges, digits)


def edge_rows(df: DataFrame, by: list[str], hashed: str, edges: DataFrame, digits: int) -> DataFrame:
    """The rows whose hash begins with the prefix of their group's edge, with ``__need``."""
    prefixed = df.withColumn("__prefix", F.substring(hashed, 1, digits))
    return join_same_keys(prefixed, edges.drop("__count"), [*by, "__prefix"])


def hash_quota_thresholds(
    df: DataFrame, by: list[str], hashed: str, key: str, quota: Callable[[Column], Column], out: str = "threshold"
) -> DataFrame:
    """Per group, (hash, key) of its ``quota(n)``-th row along them; ``hashed`` is a hex text.

    Only the rows next to the end of each quota are ranked.
    """
    slim = df.select(*dict.fromkeys([*by, hashed, key]))
    edges, digits = quota_edges(slim, by, hashed, quota)
    near = edge_rows(slim, by, hashed, edges, digits)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(hashed, key))
    return near.withColumn("__rank", rank).where("__rank = __need").select(*by, F.struct(hashed, key).alias(out))


def within_threshold(order: list[str], threshold: str = "threshold") -> Column:
    return F.coalesce(F.struct(*order) <= F.col(threshold), F.lit(False))


def head_per_group(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """First ``n`` rows of each group; the rows are filtered in place, not shuffled."""
    if not by:
        return df.orderBy(*order).limit(n)
    sliced, slices = add_slices(df, order)
    limits = small_side(quota_thresholds(sliced, by, order, slices, lambda total: F.lit(n)))
    return join_same_keys(df, limits, by).where(within_threshold(order)).drop("threshold")


def dense_index(df: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct texts in byte order, numbered from 0; cut into slices of about equal counts."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    numbered = add_rank(values, [], [column], out)
    return numbered.select(column, (F.col(out) - 1).cast("bigint").alias(out))
