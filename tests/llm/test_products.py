"""Exact top-k and hard negatives: against plain Python over all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import hard_negatives, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def whole(vector, factor):
    return [math.floor(factor * float(np.float32(x))) for x in vector]


def sound(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def plain_topk(rows, asks, k):
    vectors = {(i, tuple(whole(v, topk.FACTOR))) for i, v, _ in rows if i is not None and sound(v)}
    out = []
    for q, a in {x for x in vectors if asks(x[0])}:
        scored = sorted((-dot(a, b), i) for i, b in vectors if i != q and len(a) == len(b))[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def plain_negatives(rows, asks, positives=5, negatives=3):
    f = hard_negatives
    vectors = {(i, tuple(whole(v, f.FACTOR)), y) for i, v, y in rows if i is not None and y is not None and sound(v)}
    out = []
    for anchor, a, label in vectors:
        if not asks(anchor):
            continue
        scored = sorted((-dot(a, b), i, y) for i, b, y in vectors if i != anchor and len(a) == len(b))
        for p, positive, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [(s, i) for s, i, y in scored if y != label and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(anchor, positive, rank, i, -p, -s) for rank, (s, i) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def vectors_of(kind, n=400, d=8, seed=1):
    """Gaussian, clustered, of very different lengths, or few distinct ones with many copies and ties."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    if kind == "clustered":
        x = r.normal(size=(12, d))[r.integers(0, 12, n)] + 0.02 * x
    if kind == "lengths":
        x *= 10 ** r.uniform(-2, 3, (n, 1))
    if kind == "copies":
        x = np.where(r.random((n, 1)) < 0.4, x[0], np.round(x[:, :1].repeat(d, 1)))
    ids = np.arange(n)
    r.shuffle(ids)
    return [(int(i), v.tolist(), int(r.integers(0, 4))) for i, v in zip(ids, x, strict=True)]


ODD = [
    (None, [1.0] * 8, 1), (10, None, 1), (20, [1.0] * 7 + [None], 1), (30, [float("nan")] + [1.0] * 7, 2), (40, [float("inf")] * 8, 1),
    (50, [0.0] * 8, 1), (60, [1.0, 2.0], 1), (61, [2.0, 1.0], 2), (62, [], 1), (70, [1.0] * 8, None), (60, [1.0, 2.0], 1), (80, [3.0, 3.0], 1),
    (90, [], 2),
]


@pytest.mark.parametrize("kind", ["gaussian", "clustered", "lengths", "copies"])
def test_topk_against_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 16)
    monkeypatch.setattr(topk, "COORDINATE_FROM", 0.3)
    rows = vectors_of(kind) + [(1000 + (i or 0), v, y) for i, v, y in ODD] + [(None, [5.0] * 8, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("score", "rank", "row", "block", "dim", "ids")})
    found = topk.largest_products(df.where("vec_id % 10 = 0"), df, k=5, block_rows=64, query_block=16)
    got = sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect())
    assert got == plain_topk(rows, lambda i: i % 10 == 0, 5)


def test_coordinates_keep_every_near_row():
    """Rows left out by coordinates have a smaller cosine than the threshold."""
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(500, 6)) * 100).astype(np.int64)
    block = type("B", (), {"vectors": x})
    bucket = topk.Bucket(block, slice(0, 500))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    left_out = 0
    for q in unit[:50]:
        for cosine in (-0.5, 0.1, 0.5, 0.9, 0.999, 1.0):
            near = set(bucket.near(q, cosine).tolist())
            assert set(np.flatnonzero(unit @ q >= cosine).tolist()) <= near
            left_out += 500 - len(near)
    assert left_out > 20_000


def test_products_beyond_doubles_are_exact(spark):
    rows = [(i, [2.0**40 + i * 2.0**18, 2.0**38 - i], 0) for i in range(-3, 4) if i] + [(0, [1.0, 3.0], 0), (100, [-3.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = topk.largest_products(df.where("vec_id in (0, 100)"), df, k=4).collect()
    vectors = {i: [math.floor(1024 * x) for x in v] for i, v, _ in rows}
    for q in (0, 100):
        scored = sorted((-dot(vectors[q], v), i) for i, v in vectors.items() if i != q)[:4]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(i, -s) for s, i in scored]


@pytest.mark.parametrize("kind", ["gaussian", "clustered", "lengths", "copies"])
def test_hard_negatives_against_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(hard_negatives, "STEP_ROWS", 16)
    rows = vectors_of(kind, seed=2) + [(1000 + i, v, y) for i, v, y in ODD if i is not None] + [(None, [5.0] * 8, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("slot", "rank", "block", "dim", "ids", "tag", "place")})
    found = hard_negatives.hard_negatives(df.where("vec_id % 10 = 0"), df, block_rows=64, anchor_block=16)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(tuple(r) for r in found.select(*names).collect())
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert got == want and (kind == "copies" or len(want) > 50)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert topk.largest_products(df, df).count() == 0
    assert hard_negatives.hard_negatives(df, df).count() == 0
    some = spark.createDataFrame(vectors_of("gaussian", 20), SCHEMA)
    assert topk.largest_products(df, some).count() == 0
    assert hard_negatives.hard_negatives(some.where("vec_id = 3"), some.where("vec_id = 3")).count() == 0


def test_limits_of_a_window():
    for p in range(-50, 51):
        low, high = hard_negatives.limits(p, 50, 95)
        assert [s for s in range(-60, 60) if 50 * p <= 100 * s <= 95 * p] == list(range(low, high + 1))
