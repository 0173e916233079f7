import datetime
import decimal
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.operators.split import (
    random_split,
    ratio_split,
    repeated_stratified_holdout,
    split_summary,
    stratified_sample,
)
from granary.plans import ranks
from granary.plans.ranks import add_rank, dense_index, head_per_group
from granary.plans.slices import PART, add_parts


def walk(n: int, ratio: float) -> list[str]:
    """The rule itself: top train up to the rounded share, one row at a time."""
    train, out = 0, []
    for seen in range(n):
        goes = train < round((seen + 1) * ratio)
        train += goes
        out.append("train" if goes else "test")
    return out


@pytest.mark.parametrize(
    "n, ratio, expected",
    [
        (5, 0.6, ["train", "test", "train", "test", "train"]),
        (4, 0.5, ["test", "train", "train", "test"]),
        (3, 0.0, ["test"] * 3),
        (3, 1.0, ["train"] * 3),
    ],
)
def test_ratio_split_first_rows(spark, n, ratio, expected):
    assert walk(n, ratio) == expected
    rows = spark.range(n).withColumn("Label", F.lit("a")).withColumn("source", F.lit("f"))
    got = ratio_split(rows, ["id"], ratio).orderBy("id").collect()
    assert [r["split"] for r in got] == expected


@settings(max_examples=8, deadline=None)
@given(ratio=st.floats(0, 1), seed=st.integers(0, 99))
def test_ratio_split_is_the_sequential_rule(spark, ratio, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, Label string").repartition(5)
    got = {r["id"]: r["split"] for r in ratio_split(df, ["id"], ratio, ("Label",)).collect()}
    for label in {lab for _, lab in rows}:
        ids = [i for i, lab in rows if lab == label]
        assert [got[i] for i in ids] == walk(len(ids), ratio)


def test_result_does_not_depend_on_partitions(spark):
    df = spark.range(2000).withColumn("Label", F.concat(F.lit("l"), F.col("id") % 3))
    results = set()
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n + 8)
        split = ratio_split(df.repartition(n), ["id"], 0.6, ("Label",))
        sample = stratified_sample(df.repartition(n), "id", "Label")
        results.add(
            (
                tuple(sorted((r["id"], r["split"]) for r in split.collect())),
                tuple(sorted(r["id"] for r in sample.collect())),
            )
        )
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert len(results) == 1


def test_rank_with_a_hot_leading_value(spark):
    """Half of all rows share the first order column; they are cut by the second one."""
    rows = [("k", 5 if i % 2 else i, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "key string, a bigint, b bigint")
    got = add_rank(df, ["key"], ["a", "b"]).collect()
    expected = {(a, b): n for n, (_, a, b) in enumerate(sorted(rows), 1)}
    assert {(r["a"], r["b"]): r["rank"] for r in got} == expected


def test_rank_by_text_and_missing_values(spark):
    rows = [(None if i == 3 else f"name-{i:03d}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "t string, i int")
    got = add_rank(df.withColumn("g", F.lit(1)), ["g"], ["t", "i"]).collect()
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [r["i"] for r in sorted(got, key=lambda r: r["rank"])] == [i for _, i in expected]


def test_head_per_group_keeps_small_groups_whole(spark):
    df = spark.range(500).withColumn("g", F.when(F.col("id") < 490, "big").otherwise("small"))
    got = head_per_group(df, ["g"], ["id"], 50).collect()
    assert sorted(r["id"] for r in got) == [*range(50), *range(490, 500)]


def test_dense_index_sorts_by_bytes(spark):
    df = spark.createDataFrame([("b",), ("B",), ("a",), ("b",)], "Label string")
    got = {r["Label"]: r["i"] for r in dense_index(df, "Label", "i").collect()}
    assert got == {"B": 0, "a": 1, "b": 2}


def test_holdouts_keep_shares_and_single_rows(spark):
    df = spark.range(101).withColumn("Label", F.when(F.col("id") == 100, "one").otherwise("many"))
    got = repeated_stratified_holdout(df, "id", k=3, test=0.3).collect()
    for i in range(3):
        held = [r["id"] for r in got if r[f"test_{i}"]]
        assert len(held) == 30 and 100 not in held
    assert len({tuple(sorted(r["id"] for r in got if r[f"test_{i}"])) for i in range(3)}) == 3


def test_random_split_is_stable_and_near_its_share(spark):
    df = spark.range(4000)
    a = {r["id"]: r["split"] for r in random_split(df, "id").collect()}
    b = {r["id"]: r["split"] for r in random_split(df.repartition(3), "id").collect()}
    assert a == b
    assert abs(sum(s == "train" for s in a.values()) / 4000 - 0.6) < 0.03


def test_summary_has_totals(spark):
    rows = [("f", "train"), ("f", "test"), ("g", "train")]
    got = split_summary(spark.createDataFrame(rows, "source string, split string")).collect()
    assert {(r["source"], r["train_rows"], r["test_rows"]) for r in got} == {
        ("f", 1, 1), ("g", 1, 0), (None, 2, 1),
    }


def test_no_part_holds_a_hot_group(spark):
    """A label with half of all rows, ordered by a column that is itself skewed."""
    df = spark.range(100_000).select(
        "id",
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("l"), F.col("id") % 9)).alias("Label"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("a"),
    )
    parted = add_parts(df, ["Label"], ["a", "id"])
    largest = parted.groupBy(PART).count().agg(F.max("count")).first()[0]
    assert largest < 2 * 100_000 / 8
    ranked = add_rank(df, ["Label"], ["a", "id"])
    ends = ranked.groupBy("Label").agg(F.max("rank").alias("m"), F.count_distinct("rank").alias("n"), F.count("id").alias("c"))
    assert all(r["m"] == r["n"] == r["c"] for r in ends.collect())


def test_sample_by_hash_matches_the_full_ranking(spark):
    df = spark.range(5000).withColumn("Label", F.when(F.col("id") % 10 < 7, "hot").otherwise("cold"))
    got = {r["id"] for r in stratified_sample(df, "id", share=0.37).collect()}
    ids = {"hot": [], "cold": []}
    for i in range(5000):
        ids["hot" if i % 10 < 7 else "cold"].append((hashlib.md5(f"{i}-42".encode()).hexdigest(), i))
    want = {i for rows in ids.values() for _, i in sorted(rows)[: int(len(rows) * 0.37)]}
    assert got == want


PREFIX = "a long common prefix of every single value "


def _decimal(i):
    return decimal.Decimal(i) / 7


ORDER_VALUES = {
    "string": lambda i: f"{PREFIX}{i % 50:05d}",
    "string null": lambda i: None if i % 7 == 0 else ["", "é", "Z", "a\x00b", PREFIX * 3, "\U0001f642"][i % 6],
    "double": lambda i: [float("nan"), float("inf"), -float("inf"), None, -0.0, 0.0, 1e300, 5e-324][i % 8],
    "bigint": lambda i: 2**60 + i % 11 if i % 2 else -(2**60) - i % 5,
    "decimal(38,10)": lambda i: _decimal(i % 40),
    "date": lambda i: None if i % 9 == 0 else datetime.date(1900 + i % 30, 1, 1),
    "timestamp_ntz": lambda i: datetime.datetime(1970, 1, 1, 0, 0, 0, i % 13),
    "binary": lambda i: bytes([i % 3, 255 - i % 5]),
    "boolean": lambda i: [True, False, None][i % 3],
}


@pytest.mark.parametrize("kind", ORDER_VALUES)
def test_rank_is_a_plain_row_number(spark, kind):
    """Slices follow Spark's own order for any type, with equal values cut by the second column."""
    value = ORDER_VALUES[kind]
    rows = [("hot" if i % 3 else None, value(i), i) for i in range(600)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, f"g string, v {kind.split()[0]}, id bigint")
    plain = F.row_number().over(Window.partitionBy("g").orderBy("v", "id"))
    want = {r["id"]: r["n"] for r in df.withColumn("n", plain).collect()}
    assert {r["id"]: r["rank"] for r in add_rank(df, ["g"], ["v", "id"]).collect()} == want
    head = {r["id"] for r in head_per_group(df, ["g"], ["v", "id"], 10).collect()}
    assert head == {i for i, n in want.items() if n <= 10}


def test_text_keys_spread_over_slices(spark):
    df = spark.range(40_000).select(F.concat(F.lit(PREFIX), F.lpad("id", 8, "0")).alias("name"))
    parted = add_parts(df, [], ["name"])
    sizes = [r["count"] for r in parted.groupBy(PART).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 2 * 40_000 / len(sizes)


def test_many_labels_that_begin_alike(spark):
    df = spark.range(30_000).select(F.concat(F.lit(PREFIX), F.lpad("id", 6, "0")).alias("Label"))
    got = dense_index(df, "Label", "i")
    assert got.where(F.col("i") != F.substring("Label", -6, 6).cast("bigint")).count() == 0


def test_no_ranked_group_beyond_the_bound(spark, monkeypatch):
    """One label with 90 % of the rows: prefixes grow until few rows are left to rank."""
    monkeypatch.setattr(ranks, "RANKED_ROWS", 4)
    df = spark.range(60_000).select(
        "id", F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("Label"), F.md5(F.col("id").cast("string")).alias("h")
    )
    edges, digits = ranks.quota_edges(df, ["Label"], "h", lambda n: F.floor(n * 0.3))
    assert edges.agg(F.max("__count")).first()[0] <= 4 and digits > ranks.HASH_DIGITS
    got = {r["Label"]: r["threshold"] for r in ranks.hash_quota_thresholds(df, ["Label"], "h", "id", lambda n: F.floor(n * 0.3)).collect()}
    for label, n in (("hot", 54_000), ("cold", 6_000)):
        rows = sorted((r["h"], r["id"]) for r in df.where(F.col("Label") == label).collect())
        assert tuple(got[label]) == rows[int(n * 0.3) - 1]
