import math
import os

import pytest
from pyspark.sql import functions as F

from granary.functions import scalars as X
from granary.operators import checks as K
from granary.operators import clean as C
from granary.operators import features as M
from granary.operators import schema as S
from granary.operators.relations import grid_product
from granary.plans.small import small_rows
from granary.session import release_intermediates, written


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_union_columns_puts_the_label_last():
    assert S.union_columns(["b", "a", " Label"], ["a", "c", "label"]) == ["a", "b", "c", "Label"]


def test_exact_label_wins_and_variants_go(spark):
    df = spark.createDataFrame([(1, 2, 3)], "` label` int, Label int, x int")
    assert S.standardize_label(df).columns == ["Label", "x"]
    first = spark.createDataFrame([(1, 2)], "LABEL int, label int")
    assert S.standardize_label(first).first().asDict() == {"Label": 1}
    assert S.standardize_label(spark.createDataFrame([(1,)], "` label` int"), strip=False).columns == [" label"]


def test_source_without_label_loses_its_rows(spark):
    a = spark.createDataFrame([(1, "x")], "v int, label string")
    b = spark.createDataFrame([(2.5,)], "v double")
    merged = S.consolidate({"a": a, "b": b})
    assert merged.columns == ["source", "v", "Label"]
    assert [r["v"] for r in C.drop_null_labels(merged).collect()] == [1.0]
    report = {r["source"]: (r["rows"], r["dropped"]) for r in S.dropped_rows(merged).collect()}
    assert report == {"a": (1, 0), "b": (1, 1)}


@pytest.mark.parametrize(
    "values, dtype",
    [
        (["1", "-2"], "int64"),
        (["1", "NA"], "float64"),
        (["1", "2.5", "inf"], "float64"),
        (["True", "False"], "bool"),
        (["True", ""], "object"),
        (["1d", "2"], "object"),
        (["NaN", ""], "float64"),
        (["99999999999999999999"], "float64"),
    ],
)
def test_inferred_types(spark, values, dtype):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    assert S.infer_types(df).first()["dtype"] == dtype


def test_schema_comparison(spark):
    a = S.schema_relation(spark, ["x", "y"])
    b = S.schema_relation(spark, ["y", "x", "z"])
    assert not S.schema_equal(a, b).first()["equal"]
    assert S.schema_equal(a, a).first()["equal"]
    got = {(r["side"], r["name"]) for r in S.schema_missing(a, b, "train", "test").collect()}
    assert got == {("test", "z")}


def test_clip_keeps_missing_values(spark):
    rows = [(None,), (float("nan"),), (2e6,), (-2e6,), (5.0,)]
    df = spark.createDataFrame(rows, "c double")
    got = [r["c"] for r in C.clip(C.null_out_infinities(df)).collect()]
    assert got == [None, None, 1e6, -1e6, 5.0]


def test_mean_imputation(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    got = C.impute_mean(df, ["a", "b"]).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.0), (2.0, 0.0), (3.0, 0.0)]


def test_repair_and_report(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (1.0,)], "c double")
    fixed, found = C.validate_finite(df, ["c"])
    assert found == {"n_inf": 2, "n_nan": 1}
    assert [r["c"] for r in fixed.collect()] == [1e6, 1e6, 0.0, 1.0]
    clean, none = C.validate_finite(fixed, ["c"])
    assert clean is fixed and not any(none.values())


@pytest.mark.parametrize("rows, distinct, expected", [(200, 60, True), (200, 150, False), (30, 30, True)])
def test_low_cardinality(spark, rows, distinct, expected):
    df = spark.range(rows).select(F.concat(F.lit("v"), F.col("id") % distinct).alias("c"))
    assert C.low_cardinality_columns(df).first()["is_categorical"] is expected
    assert C.low_cardinality_columns(df, approximate=True).first()["is_categorical"] is expected


def test_narrow_integers(spark):
    df = spark.createDataFrame([(-128, 128, 40000, 2**31)], "a bigint, b bigint, c bigint, d bigint")
    kinds = [f.dataType.simpleString() for f in C.narrow_integers(df).schema.fields]
    assert kinds == ["tinyint", "smallint", "int", "bigint"]


def test_sanitize_order_and_odd_names(spark):
    df = spark.createDataFrame(
        [(3e6, 1, "x"), (float("inf"), 2, None), (float("nan"), 3, "y")], "`a.b` double, n bigint, ` LABEL ` string"
    )
    got = C.sanitize(df, ["a.b", "n", "extra", "Label"]).collect()
    assert [tuple(r) for r in got] == [(1e6, 1, None, "x"), (None, 3, None, "y")]


def test_standardize(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "x double, c double")
    stats = M.fit_standardizer(df, ["x", "c"])
    assert {r["name"]: round(r["std"], 6) for r in stats.collect()} == {"x": 1.247219, "c": 0.0}
    scaled = M.standardize(df, stats)
    row = scaled.agg(F.avg("x"), F.stddev_pop("x"), F.max("c")).first()
    assert row[0] == pytest.approx(0, abs=1e-12) and row[1] == pytest.approx(1) and row[2] == 0.0


def test_matrix_equals_impute_then_standardize(spark):
    rows = [(i, "b" if i % 3 else "a", None if i % 4 == 0 else float(i * i), float("inf") if i == 5 else 1.0 * i)
            for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, Label string, x double, y double")
    matrix = M.build_training_matrix(df, keep=("id",))
    assert matrix.numeric_cols == ["x", "y"] and matrix.classes == ["a", "b"]
    filled = C.impute_mean(C.null_out_infinities(df, ["x", "y"]), ["x", "y"])
    expected = M.standardize(filled, M.fit_standardizer(filled, ["x", "y"]))
    want = {r["id"]: (r["x"], r["y"]) for r in expected.collect()}
    for r in matrix.data.collect():
        assert r["features"] == pytest.approx(list(want[r["id"]]), abs=1e-9)
    assert K.verdict(K.all_checks(matrix.data, 2, 2)).first()["passed"]


def test_matrix_fitted_on_train_rows_only(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "a", 3.0), (2, "b", 100.0)], "id int, Label string, x double")
    data = M.build_training_matrix(df, cols=["x"], keep=("id",), fit_where=F.col("id") < 2).data
    assert {r["id"]: r["features"][0] for r in data.collect()} == {0: -1.0, 1: 1.0, 2: 98.0}


def test_failing_checks(spark):
    bad = spark.createDataFrame([([1.0], 0), ([1.0, 2.0], 3), (None, 1)], "features array<double>, label_idx int")
    got = {r["check_name"]: r["status"] for r in K.all_checks(bad, 2, 3).collect()}
    assert got == {"row_alignment": "ERROR", "width": "ERROR", "label_range": "ERROR"}
    empty = bad.limit(0)
    assert {r["status"] for r in K.all_checks(empty, 2, 3).collect()} == {"OK"}
    parts = spark.createDataFrame([("X",), ("y",)], "name string")
    assert K.check_required_fields(parts).first()["detail"] == "missing: classes, numeric_cols"


def test_grid_product_order(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [10, 20, 30])], "k int, p array<string>, q array<int>")
    got = sorted(tuple(r) for r in grid_product(df, ["p", "q"]).select("combo_idx", "p", "q").collect())
    assert got == [(1, "a", 10), (2, "a", 20), (3, "a", 30), (4, "b", 10), (5, "b", 20), (6, "b", 30)]


@pytest.mark.parametrize("value, digits", [(0.58875, 4), (2.675, 2), (0.125, 2), (0.375, 2), (1e-9, 4), (-2.5, 0), (123456.785, 2), (0.84, 4)])
def test_decimals_as_python_prints_them(spark, value, digits):
    got = float(one(spark, X.fixed_decimals(F.lit(value), digits)))
    assert got == float(f"{value:.{digits}f}")


@pytest.mark.parametrize("n, text", [(0, "0.0B"), (1023, "1023.0B"), (1536, "1.5KB"), (1280, "1.2KB"), (5 * 1024**4, "5.0TB"), (3000 * 1024**4, "3000.0TB")])
def test_human_bytes(spark, n, text):
    assert one(spark, X.human_bytes(F.lit(n))) == text


def test_scalars(spark):
    assert one(spark, X.clip(F.lit(None).cast("double"), 0, 1)) is None
    assert one(spark, X.to_number(F.lit(" 1e3 "))) == 1000.0
    assert one(spark, X.to_number(F.lit("12f"))) is None
    assert math.isinf(one(spark, X.to_number(F.lit("-Infinity"))))
    assert one(spark, X.present(F.lit("NULL"))) is None
    assert one(spark, X.canonical_value(F.lit("1"))) == one(spark, X.canonical_value(F.lit("1.0")))
    assert one(spark, X.hms(F.lit(90061))) == "1 day, 1:01:01"


def test_small_sides_are_checked_by_rows_and_bytes(spark):
    few = spark.range(10).withColumn("t", F.lit("x" * 1000))
    assert len(small_rows(few)) == 10
    assert small_rows(few, max_rows=9) is None and small_rows(few, max_bytes=5000) is None


def test_small_sides_of_large_rows_stay_away(spark):
    """Texts of 1 MB: no more of them than the bound come to the driver, and none of a larger relation."""
    texts = spark.range(40).select(F.repeat(F.lit("x"), 1_000_000).alias("t"), "id", F.array("id").alias("a"))
    assert small_rows(texts) is None
    assert [r.id for r in small_rows(texts.where("id < 6"))] == list(range(6))
    assert small_rows(texts.where("id = 3"), max_bytes=900_000) is None
    odd = spark.createDataFrame([(None, None), ("", None), ("é", {"k": 1})], "t string, m map<string,int>")
    assert sorted(small_rows(odd), key=str) == sorted(odd.collect(), key=str)


def test_distinct_counts_in_stages(spark):
    """Few values, many, none, and only NULL; exact in both stages, and nothing is shuffled for the few."""
    df = spark.range(3000).select(
        (F.col("id") % 60).cast("string").alias("few"),
        F.col("id").cast("string").alias("many"),
        F.lit(None).cast("string").alias("none"),
        F.when(F.col("id") % 3 > 0, F.concat(F.repeat(F.lit("long"), 9000), (F.col("id") % 7).cast("string"))).alias("long"),
    )
    got = {r["name"]: (r["rows"], r["distinct_values"], r["is_categorical"]) for r in C.low_cardinality_columns(df).collect()}
    assert got == {"few": (3000, 60, True), "many": (3000, 3000, False), "none": (3000, 1, True), "long": (3000, 8, True)}
    assert C.low_cardinality_columns(df.where("id < 0"), ["few"]).first()["distinct_values"] == 0


def test_names_in_any_case_need_the_setting(spark):
    plain = spark.newSession()
    plain.conf.set("spark.sql.caseSensitive", "false")
    halves = lambda s: {"a": s.range(1).withColumnRenamed("id", "Flow"), "b": s.range(1).withColumnRenamed("id", "flow")}
    with pytest.raises(ValueError, match="caseSensitive"):
        S.consolidate(halves(plain))
    assert S.consolidate(halves(spark)).columns == ["source", "Flow", "flow"]


def test_metadata_lists_all_classes(spark, monkeypatch):
    import granary.operators.features as X

    df = spark.range(300).select(F.col("id").cast("double").alias("x"), F.format_string("c%03d", "id").alias("Label"))
    monkeypatch.setattr(X, "small_rows", lambda df: small_rows(df, max_rows=100))
    row = X.build_training_matrix(df).metadata().first()
    assert row["classes"] == [f"c{i:03d}" for i in range(300)] and row["numeric_cols"] == ["x"]


def test_many_classes_stay_a_table(spark, monkeypatch):
    import granary.operators.features as X

    df = spark.range(300).select(F.col("id").cast("double").alias("x"), F.concat(F.lit("c"), F.col("id")).alias("Label"))
    monkeypatch.setattr(X, "small_rows", lambda df: small_rows(df, max_rows=100))
    matrix = X.build_training_matrix(df)
    assert matrix.classes is None and matrix.index.count() == 300
    assert matrix.data.agg(F.count_distinct("label_idx")).first()[0] == 300


def test_intermediates_can_be_released(spark):
    place = written(spark.range(3), "gone").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(place)
    assert release_intermediates(spark) >= 1 and not os.path.exists(place)
