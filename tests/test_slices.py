"""Slices: bounds of any types, short for long texts, and never against the order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from granary.plans import ranks as R
from granary.plans import slices as S


def frame(spark, kind, n=600):
    r = random.Random(kind)
    rows = []
    for i in range(n):
        text = {
            "words": lambda: "".join(r.choice("aé🙂\x00z") for _ in range(r.randrange(4))),
            "copies": lambda: "one long text " * 50 if r.random() < 0.6 else f"one long text {r.randrange(9)}",
            "shared beginning": lambda: "x" * 5000 + str(r.randrange(40)),
        }[kind]()
        real = r.choice([None, float("nan"), float("inf"), -0.0, 0.0, r.random()])
        rows.append((None if r.random() < 0.05 else text, real, r.randrange(3), i))
    return spark.createDataFrame(rows, "t string, x double, k int, i long").repartition(4)


@pytest.mark.parametrize("tree", [0, 128])
@pytest.mark.parametrize("order", [["t", "i"], ["k", "t", "x", "i"], ["x", "t", "i"]])
@pytest.mark.parametrize("kind", ["words", "copies", "shared beginning"])
def test_slices_follow_the_order(spark, monkeypatch, kind, order, tree):
    monkeypatch.setattr(S, "TREE_BOUNDS", tree)
    df = frame(spark, kind)
    bounds = S.slice_bounds(df, order)
    assert len(bounds) >= 6
    placed = df.select("*", S.slice_index(df, order, bounds).alias("s")).orderBy(*order).select("s")
    found = [r.s for r in placed.coalesce(1).collect()]
    assert found == sorted(found) and len(set(found)) >= 7
    assert max(found.count(s) for s in set(found)) < 300
    ranked = R.add_rank(df, [], order).orderBy(*order).select("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 601))


def test_bounds_of_long_texts_are_short(spark):
    """Texts of 1 MB that differ early; copies of one beside them are cut along the next column."""
    texts = spark.range(60).select(
        F.when(F.col("id") < 25, F.repeat(F.lit("same"), 250_000)).otherwise(F.concat(F.md5(F.col("id").cast("string")), F.repeat(F.lit("tail"), 250_000))).alias("t"),
        "id",
    )
    bounds = S.slice_bounds(texts.repartition(4), ["t", "id"])
    sizes = [len(b[0] or "") for b in bounds]
    assert len(bounds) >= 2 and sum(sizes) <= S.BOUND_BYTES
    assert sorted(sizes)[0] <= 2
    early = texts.where("id >= 25")
    assert max(len(b[0]) for b in S.slice_bounds(early, ["t", "id"])) <= 3


def test_shared_length(spark):
    pairs = [("", ""), ("a", "a"), ("ab", "ac"), ("é🙂x", "é🙂y"), ("abc", "ab"), ("x" * 5000 + "1", "x" * 5000 + "2")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(S._shared_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r.n for r in got] == [0, 1, 1, 2, 2, 5000]
