"""Slices: contiguous pieces of an ordering, as a function of the row alone.

A window over a hot key would sort all its rows in one task. Operators cut the
ordering into slices of about equal row counts, work per (key, slice) and carry
a small per-slice summary forward. The slice of a row depends only on its own
order columns and on literal bounds, so a recomputed task finds the same slice.

Bounds are places in the ordering itself: a row is placed by Spark's own comparison
of the order columns (NULL first, NaN last), in their own types. So a value that
very many rows share is cut along the next columns, and no slice can contradict
the order. Of a text a bound holds only the beginning that tells it from its neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "__part"
MIN_SLICES = 8
ROWS_PER_SLICE = 2_000_000
# Rows per slice that are read to place the bounds: usual, and at least.
SAMPLE_PER_SLICE, LEAST_PER_SLICE = 100, 20
# Bytes of all bounds of an ordering; bounds up to which a row is placed by generated comparisons.
BOUND_BYTES, TREE_BOUNDS = 4 << 20, 128


def slice_count(df: DataFrame, rows: int) -> int:
    """As many slices as shuffle partitions, or more when they would grow too long.

    The sample grows with the shuffle partitions, and so do the slices it can place.
    """
    partitions = max(MIN_SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    most = partitions * SAMPLE_PER_SLICE // LEAST_PER_SLICE
    return max(partitions, min(most, rows // ROWS_PER_SLICE))


def _shared_length(a: Column, b: Column) -> Column:
    """Characters that two texts begin with alike: found by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(31))])
    most = F.least(F.length(a), F.length(b))

    def step(at: Column, width: Column) -> Column:
        # In this order: a step beyond either text is not looked at.
        return F.when(width > most - at, at).when(F.left(a, at + width) == F.left(b, at + width), at + width).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _least_bound(order: list[str], types: dict[str, T.DataType]) -> list[Column]:
    """The shortest values that lie above ``__prev`` and not above ``__row``: what follows the first different column is NULL."""
    out, same = [], F.lit(True)
    for c in order:
        before_, own = F.col("__prev")[c], F.col("__row")[c]
        equal = before_.eqNullSafe(own)
        short = own
        if isinstance(types[c], T.StringType):
            short = F.when(before_.isNull(), F.left(own, F.lit(1))).otherwise(F.left(own, _shared_length(before_, own) + 1))
        out.append(F.when(same, F.when(equal, own).otherwise(short)).alias(c))
        same = same & equal
    return out


def slice_bounds(df: DataFrame, order: list[str]) -> list:
    """Bounds (of the order columns) between the slices, in order; NULL comes first.

    They lie next to quantiles of a sample whose size depends on the number of slices
    only; the balance of the slices depends on them, never a result. A bound has the least
    that tells it from the sampled row before it: the beginning of a text, or where many rows
    share a value, that value and the next column. If they have more than ``BOUND_BYTES``
    together, every second, third ... is taken.
    """
    slim = df.select(*order)
    rows = slim.count()
    n = slice_count(df, rows)
    share = SAMPLE_PER_SLICE * max(MIN_SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = share / max(rows, 1)
    sample = slim if share >= 1 else slim.sample(share, seed=1)
    types = {c: df.schema[c].dataType for c in order}
    along = Window.orderBy(*order)
    placed = sample.select(
        F.struct(*order).alias("__row"),
        F.lag(F.struct(*order)).over(along).alias("__prev"),
        (F.row_number().over(along) - 1).cast("long").alias("__k"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("__size"),
    )
    nth = F.expr(f"(__k * {n} + __size - 1) div __size")
    chosen = placed.withColumn("__i", nth).where(f"__i between 1 and {n - 1} and (__i * __size) div {n} = __k and __k > 0")
    bounds = chosen.select("__i", *_least_bound(order, types))
    texts = [F.octet_length(c) for c in order if isinstance(types[c], (T.StringType, T.BinaryType))]
    size = sum([F.coalesce(t, F.lit(0)).cast("long") for t in texts], F.lit(0).cast("long"))
    every = F.greatest(F.lit(1), F.ceil(F.sum(size).over(Window.partitionBy()) / BOUND_BYTES))
    kept = bounds.withColumn("__every", every).where("__i % __every = 0").orderBy("__i").select(*order)
    found = [tuple(r) for r in kept.collect()]
    return [b for k, b in enumerate(found) if k == 0 or b != found[k - 1]]


def _beyond(order: list[str], bound: tuple, types: dict[str, T.DataType]) -> Column:
    """Is the row not below the bound? NULL comes first, NaN last, as in a sort."""
    test = F.lit(True)
    used = max([j for j, v in enumerate(bound) if v is not None], default=-1)
    for j in range(used, -1, -1):
        c, v = F.col(order[j]), bound[j]
        if v is None:
            test = c.isNotNull() | test
            continue
        value = F.lit(v).cast(types[order[j]])
        above = c >= value if j == used else (c > value) | ((c == value) & test)
        test = F.coalesce(above, F.lit(False))
    return test


def slice_index(df: DataFrame, order: list[str], bounds: list) -> Column:
    """How many of ``bounds`` are not beyond the row: a tree of comparisons, or with many bounds a search in an array."""
    if not bounds:
        return F.lit(0)
    types = {c: df.schema[c].dataType for c in order}
    if len(bounds) <= TREE_BOUNDS:

        def between(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            mid = (low + high) // 2
            return F.when(_beyond(order, bounds[mid], types), between(mid + 1, high)).otherwise(between(low, mid))

        return between(0, len(bounds))
    literal = F.sort_array(
        F.array(*[F.struct(*[F.lit(v).cast(types[c]).alias(c) for v, c in zip(b, order)]) for b in bounds])
    )
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    row = F.struct(*order)

    def step(at: Column, width: Column) -> Column:
        return F.when(F.get(literal, at + width - 1) <= row, at + width).otherwise(at)

    return F.aggregate(F.array(*[F.lit(w) for w in steps]), F.lit(0), step)


def add_slices(
    df: DataFrame, order: list[str], prefix: str = "__slice"
) -> tuple[DataFrame, list[str]]:
    """Add the slice column of the ordering ``order``; returns its name in a list."""
    name = f"{prefix}0"
    return df.withColumn(name, slice_index(df, order, slice_bounds(df, order))), [name]


def add_parts(
    df: DataFrame, keys: list[str], order: list[str] | None = None, slices: list[str] | None = None
) -> DataFrame:
    """Add the column ``PART``: key and slice of a row as one struct.

    Windows and joins that hash by this one column share a single shuffle; as a
    struct it is never NULL, and NULL keys form a group like any other.
    """
    drop = []
    if slices is None:
        df, slices = add_slices(df, order)
        drop = slices
    fields = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    fields += [F.col(s).alias(f"s{i}") for i, s in enumerate(slices)]
    return df.withColumn(PART, F.struct(*fields)).drop(*drop)


def part_window(order: list[str]):
    """Rows of one part in order."""
    return Window.partitionBy(PART).orderBy(*order)


def with_carry(df: DataFrame, summary: dict[str, Column], folds: dict) -> DataFrame:
    """Join to every row what the slices before (or around) its own hold.

    ``summary`` aggregates each part, with map-side combine; ``folds`` maps an
    output name to a function of the window over a key's slices in order. That
    window sees one row per slice, not the data. Apply local windows first: they
    and a sort-merge join then share one shuffle and one sort.
    """
    per_part = df.groupBy(PART).agg(*[c.alias(k) for k, c in summary.items()])
    names = df.schema[PART].dataType.names
    keys = [F.col(f"{PART}.{n}") for n in names if n.startswith("k")]
    along = Window.partitionBy(*keys).orderBy(*[F.col(f"{PART}.{n}") for n in names if n.startswith("s")])
    carried = per_part.select(
        F.col(PART).alias("__of_part"), *[fold(along).alias(name) for name, fold in folds.items()]
    )
    return df.join(carried, F.col(PART) == F.col("__of_part")).drop("__of_part")


def before(window):
    """All slices (or rows) ahead of the current one."""
    return window.rowsBetween(Window.unboundedPreceding, -1)


def upto(window):
    """The current row and all ahead of it."""
    return window.rowsBetween(Window.unboundedPreceding, 0)


def throughout(window):
    """All rows of the window."""
    return window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
