"""Projections, cleaning and filters. Wide tables get one ``select`` or one ``agg``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.scalars import clip as clip_value
from granary.functions.scalars import finite_or_null, quoted, to_number
from granary.operators.schema import LABEL, align_to_schema, standardize_label
from granary.plans.small import join_same_keys, small_side

# Clipping bounds and the repair value for leftover infinities.
CLIP_LOW, CLIP_HIGH = -1e6, 1e6
# A text column is low-cardinality below this share or this count.
CATEGORY_SHARE, CATEGORY_COUNT = 0.5, 50
# Distinct values, by a sketch, up to which a column's values are held as a set.
FEW_VALUES = 200


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Replace columns in place with a single projection."""
    return df.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns])


def numeric_fields(df: DataFrame) -> list[str]:
    """Columns with a numeric type; booleans do not count."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def fractional_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def integer_ranges(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(name, low, high, dtype)``: the smallest signed type that holds each column."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
    stats = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("name"),
                    F.min(quoted(c)).cast("bigint").alias("low"),
                    F.max(quoted(c)).cast("bigint").alias("high"),
                )
                for c in cols
            ]
        ).alias("ranges")
    ).select(F.explode("ranges").alias("r"))

    def holds(bits: int) -> Column:
        return (F.col("r.low") >= F.lit(-(2 ** (bits - 1)))) & (
            F.col("r.high") <= F.lit(2 ** (bits - 1) - 1)
        )

    kind = (
        F.when(F.col("r.low").isNull() | holds(8), "tinyint")
        .when(holds(16), "smallint")
        .when(holds(32), "int")
        .otherwise("bigint")
    )
    return stats.select("r.name", "r.low", "r.high", kind.alias("dtype"))


def narrow_integers(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Cast integer columns to the smallest type for their global range (one pass)."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
    if not cols:
        return df
    kinds = {r["name"]: r["dtype"] for r in integer_ranges(df, cols).collect()}
    return replace_columns(df, {c: quoted(c).cast(kinds[c]) for c in cols})


def narrow_floats(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Doubles stored as 32-bit floats."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return replace_columns(df, {c: quoted(c).cast("float") for c in cols})


def low_cardinality_columns(
    df: DataFrame, cols: list[str] | None = None, approximate: bool = False, rsd: float = 0.02
) -> DataFrame:
    """``(name, rows, distinct_values, is_categorical)``; NULL counts as a value.

    Sketches tell first which columns have few values: those are counted exactly from
    sets that stay small, without a shuffle of values. Only the values of the other
    columns are shuffled, distinct ones combined before. ``approximate`` takes the
    sketches for those.
    """
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return df.sparkSession.createDataFrame([], "name string, rows bigint, distinct_values bigint, is_categorical boolean")
    seen = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.approx_count_distinct(quoted(c), rsd).alias(f"n{i}") for i, c in enumerate(cols)],
        *[F.coalesce(F.max(quoted(c).isNull().cast("int")), F.lit(0)).alias(f"null{i}") for i, c in enumerate(cols)],
    ).first()
    few = [i for i in range(len(cols)) if seen[f"n{i}"] <= FEW_VALUES]
    many = [i for i in range(len(cols)) if i not in few]
    found = {i: seen[f"n{i}"] for i in many} if approximate else {}
    if few:  # sets of hashes, since a value can be long
        sets = df.agg(*[F.size(F.collect_set(F.md5(quoted(cols[i]).cast("string")))).alias(f"n{i}") for i in few]).first()
        found |= {i: sets[f"n{i}"] for i in few}
    known = [(cols[i], seen["rows"], n + seen[f"null{i}"]) for i, n in found.items()]
    counted = df.sparkSession.createDataFrame(known, "name string, rows bigint, distinct_values bigint")
    if many and not approximate:
        pairs = df.select(
            F.explode(
                F.array(*[F.struct(F.lit(cols[i]).alias("name"), quoted(cols[i]).alias("value")) for i in many])
            ).alias("p")
        ).select("p.name", "p.value")
        values = pairs.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
        counted = counted.unionByName(
            values.groupBy("name").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_values"))
        )
    share = F.col("distinct_values") / F.greatest(F.col("rows"), F.lit(1))
    return counted.withColumn(
        "is_categorical", (share < CATEGORY_SHARE) | (F.col("distinct_values") < CATEGORY_COUNT)
    )


def null_out_infinities(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NaN and infinities become NULL in fractional columns."""
    cols = fractional_fields(df) if cols is None else cols
    return replace_columns(df, {c: finite_or_null(quoted(c)) for c in cols})


def clip(
    df: DataFrame, cols: list[str] | None = None, low: float = CLIP_LOW, high: float = CLIP_HIGH
) -> DataFrame:
    """Clamp numeric columns, types kept; NULL stays NULL."""
    cols = numeric_fields(df) if cols is None else cols
    types = {f.name: f.dataType for f in df.schema.fields}
    fits = {T.ByteType(): 127, T.ShortType(): 32767}
    new = {}
    for c in cols:
        if fits.get(types[c], high) < high and -fits.get(types[c], high) > low:
            continue  # the type cannot leave the bounds
        new[c] = clip_value(quoted(c), low, high).cast(types[c])
    return replace_columns(df, new)


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text to double; what does not parse becomes NULL."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return replace_columns(
        df, {c: to_number(quoted(c)) if c in texts else quoted(c).cast("double") for c in cols}
    )


def column_means(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Mean of every column; 0.0 where a column holds no number."""
    row = df.agg(*[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return {c: 0.0 if row[i] is None else row[i] for i, c in enumerate(cols)}


def impute_mean(df: DataFrame, cols: list[str], group: str | None = None) -> DataFrame:
    """NULL becomes the column mean, or 0.0 where there is no mean.

    Global means enter the projection as literals. Per-group means come from a
    combined aggregation that is joined back, so a hot group is never gathered.
    """
    if group is None:
        means = column_means(df, cols)
        return replace_columns(df, {c: F.coalesce(quoted(c), F.lit(means[c])) for c in cols})
    names = {c: f"__mean{i}" for i, c in enumerate(cols)}
    means = df.groupBy(group).agg(*[F.avg(quoted(c)).alias(n) for c, n in names.items()])
    joined = join_same_keys(df, small_side(means), [group], "left")
    return replace_columns(
        joined, {c: F.coalesce(quoted(c), F.col(n), F.lit(0.0)) for c, n in names.items()}
    ).drop(*names.values())


def drop_null_labels(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.where(F.col(label).isNotNull())


def finite_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: infinite and NaN values over the whole block of columns."""

    def total(tests: list[Column]) -> Column:
        return F.sum(sum((F.when(t, 1).otherwise(0) for t in tests), F.lit(0)))

    infinite = [F.abs(quoted(c)) == float("inf") for c in cols]
    nans = [F.isnan(quoted(c)) for c in cols]
    return df.agg(
        F.coalesce(total(infinite), F.lit(0)).cast("bigint").alias("n_inf"),
        F.coalesce(total(nans), F.lit(0)).cast("bigint").alias("n_nan"),
    )


def repair_finite(df: DataFrame, cols: list[str], high: float = CLIP_HIGH) -> DataFrame:
    """NULL and NaN become 0, an infinity of either sign becomes ``high``."""

    def repaired(c: Column) -> Column:
        return (
            F.when(c.isNull() | F.isnan(c), F.lit(0.0))
            .when(F.abs(c) == float("inf"), F.lit(high))
            .otherwise(c)
        )

    return replace_columns(df, {c: repaired(quoted(c)) for c in cols})


def validate_finite(df: DataFrame, cols: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """Count infinities and NaN; repair the block only when there are any."""
    found = finite_report(df, cols).first().asDict()
    return (repair_finite(df, cols) if any(found.values()) else df), found


def cast_label(df: DataFrame, label: str = LABEL) -> DataFrame:
    return replace_columns(df, {label: quoted(label).cast("string")})


def sanitize(df: DataFrame, columns: list[str] | None = None, narrow: bool = True) -> DataFrame:
    """Label name, narrowing, infinities, clipping, alignment, rows without label.

    ``narrow=False`` leaves out the integer range pass and the 32-bit floats.
    """
    out = standardize_label(df)
    features = [c for c in numeric_fields(out) if c != LABEL]
    if narrow:
        ints = [
            f.name for f in out.schema.fields
            if f.name in features and isinstance(f.dataType, T.IntegralType)
        ]
        out = narrow_integers(out, ints).transform(narrow_floats)
    out = out.transform(null_out_infinities).transform(clip)
    if columns is not None:
        out = align_to_schema(out, columns, {f.name: f.dataType for f in out.schema.fields})
    return drop_null_labels(out) if LABEL in out.columns else out


def project_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """The feature block alone, as doubles."""
    return df.select(*[quoted(c).cast("double").alias(c) for c in cols])
