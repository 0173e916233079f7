"""Schema operators: union schema, label naming, alignment, comparison, type profile."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.scalars import (
    INTEGER_PATTERN,
    NUMBER_PATTERN,
    is_label_name,
    present,
    quoted,
)

LABEL = "Label"
SOURCE = "source"

# Names of the inferred column types.
TYPE_NAMES = ("bool", "int64", "float64", "object")


def _names_label(name: str, strip: bool = True) -> bool:
    return (name.strip() if strip else name).lower() == "label"


def label_column(columns: list[str], strip: bool = True) -> str | None:
    """The column that holds the label: exact ``Label``, else the first variant."""
    if LABEL in columns:
        return LABEL
    return next((c for c in columns if _names_label(c, strip)), None)


def standardize_label(df: DataFrame, strip: bool = True) -> DataFrame:
    """Name the label column ``Label``; further variants of the name are dropped."""
    chosen = label_column(df.columns, strip)
    if chosen is None:
        return df
    kept = [c for c in df.columns if c == chosen or not _names_label(c, strip)]
    return df.select(*[quoted(c).alias(LABEL if c == chosen else c) for c in kept])


def union_columns(*column_lists: list[str]) -> list[str]:
    """All names once, by lower case then raw name; label variants become a last ``Label``."""
    names = {LABEL if _names_label(c) else c for columns in column_lists for c in columns}
    return sorted(names, key=lambda c: (c == LABEL, c.lower(), c))


def check_case(spark: SparkSession, names: list[str]) -> None:
    """Names that differ only in case need a session that tells them apart."""
    alike = {n for n in names if sum(m.lower() == n.lower() for m in set(names)) > 1}
    if alike and spark.conf.get("spark.sql.caseSensitive").lower() != "true":
        raise ValueError(f"columns differ only in case: {sorted(alike)}; set spark.sql.caseSensitive to true")


def union_schema(headers: DataFrame) -> DataFrame:
    """``union_columns`` over a relation of headers ``(path, pos, name)``: ``(pos, name)``.

    The distinct names are one table's width, so the final numbering is small.
    """
    name = F.when(is_label_name("name"), F.lit(LABEL)).otherwise(F.col("name"))
    names = headers.select(name.alias("name")).distinct()
    key = F.struct((F.col("name") == LABEL).alias("l"), F.lower("name").alias("n"), F.col("name"))
    ordered = names.agg(F.array_sort(F.collect_list(key)).alias("keys"))
    return ordered.select(F.posexplode("keys").alias("pos", "key")).select(
        (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("key")["name"].alias("name")
    )


def align_to_schema(df: DataFrame, columns: list[str], types: dict | None = None) -> DataFrame:
    """Select ``columns`` in order; a missing one becomes NULL of its type."""
    types = types or {}
    present_names = set(df.columns)
    return df.select(
        *[
            quoted(c) if c in present_names else F.lit(None).cast(types.get(c, "string")).alias(c)
            for c in columns
        ]
    )


def _common_types(frames: list[DataFrame]) -> dict[str, T.DataType]:
    """One type per column: the shared one, double for mixed numbers, else string."""
    seen: dict[str, list[T.DataType]] = {}
    for df in frames:
        for field in df.schema.fields:
            seen.setdefault(field.name, []).append(field.dataType)
    out: dict[str, T.DataType] = {}
    for name, found in seen.items():
        kinds = list(dict.fromkeys(found))
        if len(kinds) == 1:
            out[name] = kinds[0]
        elif all(isinstance(t, T.IntegralType) for t in kinds):
            out[name] = T.LongType()
        elif all(isinstance(t, T.NumericType) for t in kinds):
            out[name] = T.DoubleType()
        else:
            out[name] = T.StringType()
    return out


def consolidate(sources: dict[str, DataFrame], source_column: str = SOURCE) -> DataFrame:
    """Merge sources with differing headers under one union schema, with a source key.

    Columns are matched by name. When any source has a label, rows of sources
    without one carry a NULL label.
    """
    frames = {key: standardize_label(df) for key, df in sources.items()}
    columns = union_columns(*[df.columns for df in frames.values()])
    check_case(next(iter(frames.values())).sparkSession, columns)
    types = _common_types(list(frames.values()))
    parts = []
    for key, df in frames.items():
        cast = df.select(*[quoted(c).cast(types[c]).alias(c) for c in df.columns])
        parts.append(
            align_to_schema(cast, columns, types).select(F.lit(key).alias(source_column), "*")
        )
    return reduce(DataFrame.unionByName, parts)


def union_all(parts: list[DataFrame], order: list[str] | None = None) -> DataFrame:
    """Append the rows of all parts by column name; sorted only on request."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return merged.orderBy(*order) if order else merged


def dropped_rows(df: DataFrame, source_column: str = SOURCE, label: str = LABEL) -> DataFrame:
    """Rows per source, and how many of them the missing-label rule removes."""
    return df.groupBy(source_column).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(label).isNull()).alias("dropped"),
    )


def schema_relation(spark: SparkSession, columns: list[str]) -> DataFrame:
    """``(pos, name)`` of a list of column names."""
    rows = [(i + 1, c) for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "pos bigint, name string")


def schema_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: do two ``(pos, name)`` relations hold the same names in the same order?"""
    left = a.select(F.col("pos"), F.col("name").alias("a_name"))
    right = b.select(F.col("pos").alias("b_pos"), F.col("name").alias("b_name"))
    both = left.join(right, F.col("pos") == F.col("b_pos"), "full_outer")
    same = F.coalesce(F.col("a_name") == F.col("b_name"), F.lit(False))
    return both.agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("equal"))


def schema_missing(a: DataFrame, b: DataFrame, a_side: str = "a", b_side: str = "b") -> DataFrame:
    """Names on one side only, with their position there: ``(side, pos, name)``."""

    def only(x: DataFrame, y: DataFrame, side: str) -> DataFrame:
        return x.join(y.select("name"), "name", "left_anti").select(
            F.lit(side).alias("side"), F.col("pos").cast("bigint").alias("pos"), "name"
        )

    return only(a, b, a_side).unionByName(only(b, a, b_side))


def dtype_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns whose inferred types differ between two type profiles ``(name, dtype)``."""
    left = a.select("name", F.col("dtype").alias("a_dtype"))
    right = b.select("name", F.col("dtype").alias("b_dtype"))
    both = left.join(right, "name", "full_outer")
    return both.where(~F.col("a_dtype").eqNullSafe(F.col("b_dtype")))


def _type_of_text(c: Column, integers_with_holes: str) -> Column:
    value = present(c)
    filled = F.count(value)
    missing = F.count(F.lit(1)) - filled
    ints = F.count_if(value.rlike(INTEGER_PATTERN) & value.try_cast("bigint").isNotNull())
    numbers = F.count_if(value.rlike(NUMBER_PATTERN))
    bools = F.count_if(value.isin("True", "False", "TRUE", "FALSE", "true", "false"))
    return (
        F.when(filled == 0, "float64")
        .when((ints == filled) & (missing == 0), "int64")
        .when(ints == filled, integers_with_holes)
        .when(numbers == filled, "float64")
        .when((bools == filled) & (missing == 0), "bool")
        .otherwise("object")
    )


def _type_of_field(field: T.StructField, integers_with_holes: str) -> Column:
    c = quoted(field.name)
    holes = F.count(F.lit(1)) > F.count(c)
    if isinstance(field.dataType, T.StringType):
        return _type_of_text(c, integers_with_holes)
    if isinstance(field.dataType, T.BooleanType):
        return F.when(F.count(c) == 0, "float64").when(holes, "object").otherwise("bool")
    if isinstance(field.dataType, T.IntegralType):
        return F.when(holes, integers_with_holes).otherwise("int64")
    if isinstance(field.dataType, (T.FractionalType, T.DecimalType)):
        return F.first(F.lit("float64"))
    return F.first(F.lit("object"))


def infer_types(
    df: DataFrame, sample_rows: int | None = None, nullable_integers: bool = False
) -> DataFrame:
    """``(name, dtype)`` of every column, from one aggregation over all columns.

    Text columns are judged by their values: integers, numbers, booleans, else
    ``object``; integers with holes count as ``float64`` unless
    ``nullable_integers`` keeps them apart. ``sample_rows`` limits the look to
    the first rows, as a sampling option.
    """
    holed = "int64" if nullable_integers else "float64"
    rows = df.limit(sample_rows) if sample_rows else df
    profile = rows.agg(
        F.array(
            *[
                F.struct(F.lit(f.name).alias("name"), _type_of_field(f, holed).alias("dtype"))
                for f in df.schema.fields
            ]
        ).alias("types")
    )
    return profile.select(F.explode("types").alias("t")).select("t.name", "t.dtype")


def numeric_columns(
    df: DataFrame, label: str = LABEL, sample_rows: int | None = None, texts: bool = True
) -> list[str]:
    """Names of the numeric columns in table order, without the label.

    Typed columns are known from the schema; text columns are judged by their
    values in one pass, unless ``texts`` is false.
    """
    raw = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)] if texts else []
    found = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    if raw:
        profile = infer_types(df.select(*[quoted(c) for c in raw]), sample_rows).collect()
        found |= {r["name"] for r in profile if r["dtype"] in ("int64", "float64")}
    return [c for c in df.columns if c in found and c != label]


def numeric_profile(types: DataFrame, label: str = LABEL) -> DataFrame:
    """The numeric rows of a type profile, without the label."""
    return types.where(F.col("dtype").isin("int64", "float64") & (F.col("name") != label))


def cast_by_profile(
    df: DataFrame, types: dict[str, str], skip: set[str] = frozenset(), raw: bool = True
) -> DataFrame:
    """Text columns cast by an inferred profile; in ``raw`` text, missing tokens become NULL."""
    out = []
    for c in df.columns:
        if c in skip:
            out.append(quoted(c))
            continue
        kind = types.get(c, "object")
        value = present(quoted(c)) if raw else quoted(c)
        if kind == "int64":
            value = value.try_cast("bigint")
        elif kind == "float64":
            value = value.try_cast("double")
        elif kind == "bool":
            value = F.lower(value).try_cast("boolean")
        out.append(value.alias(c))
    return df.select(*out)


def schema_fingerprint(columns: list[str]) -> str:
    """First ten hex digits of SHA-1 over the names as a compact JSON list."""
    text = "[" + ",".join('"' + c.replace("\\", "\\\\").replace('"', '\\"') + '"' for c in columns) + "]"
    return hashlib.sha1(text.encode("utf-8")).hexdigest()[:10]


def fingerprint_relation(headers: DataFrame) -> DataFrame:
    """``schema_fingerprint`` for every path of a header relation ``(path, pos, name)``."""
    names = F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda e: e["name"]
    )
    digest = F.substring(F.sha1(F.to_json(names).cast("binary")), 1, 10)
    return headers.groupBy("path").agg(digest.alias("fingerprint"))


def set_difference(a: DataFrame, b: DataFrame, key: str = "name") -> DataFrame:
    """Values of ``a`` that ``b`` does not hold, each once."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")
