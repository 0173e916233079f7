"""Standardizer, label index, feature assembly, matrix building, column statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.scalars import quoted
from granary.operators.clean import (
    clip,
    coerce_numeric,
    null_out_infinities,
    replace_columns,
)
from granary.operators.schema import LABEL, numeric_columns
from granary.plans.ranks import dense_index
from granary.plans.small import join_same_keys, small_rows, small_side


def fit_standardizer(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(name, n, mean, std)`` per column, population std, from one pass."""
    stats = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("name"),
                    F.count(quoted(c)).alias("n"),
                    F.avg(quoted(c)).alias("mean"),
                    F.stddev_pop(quoted(c).cast("double")).alias("std"),
                )
                for c in cols
            ]
        ).alias("stats")
    )
    return stats.select(F.explode("stats").alias("s")).select("s.*")


def standardize(df: DataFrame, stats: DataFrame) -> DataFrame:
    """``(x - mean) / std`` per fitted column; a constant column gives 0.0.

    The statistics have one row per column and enter the projection as literals.
    """
    fitted = {r["name"]: (r["mean"], r["std"]) for r in stats.collect()}
    new = {}
    for name, (mean, std) in fitted.items():
        centred = quoted(name).cast("double") - F.lit(mean)
        new[name] = centred / F.lit(std if std else 1.0)
    return replace_columns(df, new)


def fit_label_index(df: DataFrame, label: str = LABEL, out: str = "label_idx") -> DataFrame:
    """Distinct labels in byte order, numbered from 0.

    A few labels are numbered on the driver after a size check; many stay distributed.
    """
    values = df.select(F.col(label).cast("string").alias(label)).where(F.col(label).isNotNull()).distinct()
    rows = small_rows(values)
    if rows is None:
        return dense_index(values, label, out)
    labels = sorted((r[label] for r in rows), key=lambda v: v.encode("utf-8"))
    numbered = [(v, i) for i, v in enumerate(labels)]
    return df.sparkSession.createDataFrame(numbered, f"`{label}` string, `{out}` bigint")


def encode_labels(df: DataFrame, index: DataFrame, label: str = LABEL) -> DataFrame:
    """Add the label number; broadcast after a size check, else a shuffled join."""
    return join_same_keys(df, small_side(index), [label], "left")


def assemble_features(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """The feature columns as one array column; the other columns stay."""
    rest = [quoted(c) for c in df.columns if c not in cols]
    return df.select(*rest, F.array(*[quoted(c).cast("double") for c in cols]).alias(out))


@dataclass
class TrainingMatrix:
    """``data`` holds the kept columns, ``features`` and ``label_idx``.

    ``index`` numbers the labels; ``classes`` lists them in that order when they are few enough for the driver.
    """

    data: DataFrame
    classes: list[str] | None
    numeric_cols: list[str]
    index: DataFrame | None = None

    def metadata(self) -> DataFrame:
        """One row: all classes in the order of their numbers, and feature names; it does not pass the driver."""
        if self.index is None:
            spark = self.data.sparkSession
            return spark.createDataFrame(
                [(self.classes, self.numeric_cols)], "classes array<string>, numeric_cols array<string>"
            )
        number = "label_idx"
        label = next(c for c in self.index.columns if c != number)
        pairs = F.array_sort(F.collect_list(F.struct(F.col(number).alias("i"), quoted(label).alias("v"))))
        names = F.array(*[F.lit(c) for c in self.numeric_cols]).cast("array<string>")
        return self.index.agg(F.transform(pairs, lambda p: p["v"]).alias("classes")).withColumn("numeric_cols", names)


def scaled_values(values: list[Column], row) -> list[Column]:
    """Values imputed by their mean and standardized, from ``rows``, ``n*``, ``m*``, ``v*``.

    Filling with the mean keeps a column's mean, and its variance shrinks by the
    share of filled values; so one pass over the raw values suffices.
    """
    out = []
    for i, value in enumerate(values):
        mean = row[f"m{i}"] or 0.0
        std = ((row[f"v{i}"] or 0.0) * row[f"n{i}"] / max(row["rows"], 1)) ** 0.5
        out.append((F.coalesce(value, F.lit(mean)) - F.lit(mean)) / F.lit(std or 1.0))
    return out


def build_training_matrix(
    df: DataFrame,
    cols: list[str] | None = None,
    label: str = LABEL,
    keep: tuple[str, ...] = (),
    fit_where=None,
    sample_rows: int | None = None,
    scale: bool = True,
    clipped: bool = False,
) -> TrainingMatrix:
    """Numeric features cleaned, mean-imputed and standardized, labels encoded.

    ``clipped`` clamps the features to the bounds of ``clean.clip`` before anything is fitted.

    Two small fits (column means and spreads; labels), then one narrow projection
    with literals. ``fit_where`` restricts the rows that the fits see, which keeps
    held-out rows from leaking into the scaling; ``scale=False`` leaves the
    features unscaled, with NULL for missing values.
    """
    cols = cols or [c for c in numeric_columns(df, label, sample_rows) if c not in keep]
    base = df.select(
        *[quoted(c) for c in keep], F.col(label).cast("string").alias(label), *[quoted(c) for c in cols]
    )
    cleaned = base.transform(coerce_numeric, cols).transform(null_out_infinities, cols)
    if clipped:
        cleaned = cleaned.transform(clip, cols)
    if scale:
        fit_rows = cleaned if fit_where is None else cleaned.where(fit_where)
        row = fit_rows.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(cols)],
            *[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(cols)],
            *[F.var_pop(quoted(c)).alias(f"v{i}") for i, c in enumerate(cols)],
        ).first()
        scaled = scaled_values([quoted(c) for c in cols], row)
        cleaned = replace_columns(cleaned, dict(zip(cols, scaled)))
    index = fit_label_index(base, label)
    encoded = encode_labels(cleaned, index, label)
    few = small_rows(index)
    classes = None if few is None else [r[label] for r in sorted(few, key=lambda r: r["label_idx"])]
    return TrainingMatrix(assemble_features(encoded, cols), classes, list(cols), index)


def column_stats(df: DataFrame, cols: list[str], distinct: str | None = None) -> DataFrame:
    """Long form per column: values, infinities, NaN, mean and std of the finite values.

    One pass without a shuffle of values. ``distinct="sketch"`` adds the approximate
    number of distinct values in the same pass; ``"exact"`` counts combined (column,
    value) pairs, which sends every distinct value through a shuffle.
    """
    if distinct not in (None, "sketch", "exact"):
        raise ValueError("distinct is None, 'sketch' or 'exact'")

    def summary(name: str):
        value = quoted(name).cast("double")
        infinite, nan = F.abs(value) == float("inf"), F.isnan(value)
        finite = F.when(~(infinite | nan), value)
        fields = [
            F.lit(name).alias("name"),
            F.count(value).alias("n"),
            F.count_if(infinite).alias("n_inf"),
            F.count_if(nan).alias("n_nan"),
            F.avg(finite).alias("mean"),
            F.stddev_pop(finite).alias("std"),
        ]
        if distinct == "sketch":
            fields.append(F.approx_count_distinct(value).alias("distinct_values"))
        return F.struct(*fields)

    stats = df.agg(F.array(*[summary(c) for c in cols]).alias("stats"))
    long = stats.select(F.explode("stats").alias("s")).select("s.*")
    if distinct != "exact":
        return long
    pairs = [F.struct(F.lit(c).alias("name"), quoted(c).cast("double").alias("v")) for c in cols]
    values = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.name", "p.v")
    per_value = values.groupBy("name", "v").agg(F.count(F.lit(1)).alias("n"))
    counted = per_value.groupBy("name").agg(F.count("v").alias("distinct_values"))
    return long.join(counted, "name")

