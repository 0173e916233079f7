"""Trees: against a plain recursive grower, by nodes, limits and predictions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import trees as T

SCHEMA = "key long, features array<double>, label_idx int"


def frame(spark, x, y):
    rows = [(i, [float(v) for v in row], int(c)) for i, (row, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def noisy(n=600, seed=0, classes=3):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.integers(0, 20, n), np.round(r.normal(size=n), 1), r.integers(0, 2, n)]).astype(float)
    y = ((x[:, 0] > 9).astype(int) + (x[:, 1] > 0.5)) % classes
    noise = r.random(n) < 0.2
    y[noise] = r.integers(0, classes, noise.sum())
    return x, y


def plain_tree(x, y, classes, depth, split, leaf):
    """Nodes (number, feature, bound or None, rows per class) by recursion over sorted values."""
    out = []

    def go(rows, number, level):
        counts = np.bincount(y[rows], minlength=classes)
        best = None
        if len(rows) >= split and (counts > 0).sum() > 1 and level < depth:
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for low, high in zip(values, values[1:], strict=False):
                    left = np.bincount(y[rows][x[rows, f] <= low], minlength=classes)
                    right = counts - left
                    if min(left.sum(), right.sum()) < leaf:
                        continue
                    score = (left**2).sum() / left.sum() + (right**2).sum() / right.sum()
                    if best is None or score > best[0]:
                        best = (score, f, low, high)
        out.append((number, -1 if best is None else best[1], best and (best[2], best[3]), tuple(counts)))
        if best:
            inside = x[rows, best[1]] <= best[2]
            go(rows[inside], 2 * number, level + 1)
            go(rows[~inside], 2 * number + 1, level + 1)

    go(np.arange(len(y)), 1, 0)
    return sorted(out, key=lambda n: n[0])


def told(model):
    tree = model.trees[0]
    return list(zip(tree.node.tolist(), tree.feature.tolist(), tree.cut.tolist(), [tuple(w.astype(int)) for w in tree.weights], strict=True))


@pytest.mark.parametrize(("small", "depth", "split", "leaf"), [(10**6, 30, 2, 1), (40, 30, 2, 1), (0, 6, 2, 1), (90, 5, 25, 7), (10**6, 12, 20, 5)])
def test_tree_against_plain_recursion(spark, small, depth, split, leaf):
    """In one task, by levels alone, and by levels with small nodes grown in tasks."""
    x, y = noisy()
    model = T.fit_trees(frame(spark, x, y), None, depth, split, leaf, small_node=small)
    want = plain_tree(x, y, 3, depth, split, leaf)
    got = told(model)
    assert [(n, f, c) for n, f, _, c in got] == [(n, f, c) for n, f, _, c in want]
    for (_, f, cut, _), (_, _, bounds, _) in zip(got, want, strict=True):
        if f >= 0:  # a bound between the same two values of the node
            assert bounds[0] <= model.cuts[f][cut] < bounds[1]


def test_split_and_leaf_size_are_two_limits(spark):
    """9 rows of one class and 1 of another, split size 10: the reference rule splits them, half of 10 as leaf size would not."""
    x, y = np.arange(10.0)[:, None], np.array([0] * 9 + [1])
    df = frame(spark, x, y)
    assert T.fit_trees(df, min_split=10).trees[0].feature.tolist() == [0, -1, -1]
    assert T.fit_trees(df, min_split=11).trees[0].feature.tolist() == [-1]
    assert T.fit_trees(df, min_split=2, min_leaf=5).trees[0].n.tolist() == [10, 5, 5]
    assert T.fit_trees(df, min_split=2, min_leaf=6).trees[0].n.tolist() == [10]


def test_smaller_limits_are_read_from_one_tree(spark):
    x, y = noisy(seed=3)
    df = frame(spark, x, y)
    full = T.fit_trees(df, min_leaf=2)
    bins = T.in_bins(x, full.cuts)
    for depth, split in ((1, 2), (4, 2), (30, 50), (6, 20), (0, 2)):
        own = T.fit_trees(df, max_depth=depth, min_split=split, min_leaf=2)
        mine = [p for _, p in T.votes(full.trees, bins, depth, split, [1])][0]
        assert (mine == [p for _, p in T.votes(own.trees, bins, 99, 2, [1])][0]).all()


def test_forest_does_not_depend_on_where_nodes_are_grown(spark):
    x, y = noisy(seed=5)
    df = frame(spark, x, y)
    one = T.fit_trees(df, 12, max_depth=8, min_leaf=2, key=F.col("key"))
    other = T.fit_trees(df.repartition(3), 12, max_depth=8, min_leaf=2, key=F.col("key"), small_node=60)
    for a, b in zip(one.trees, other.trees, strict=True):
        assert a.node.tolist() == b.node.tolist() and a.feature.tolist() == b.feature.tolist() and a.cut.tolist() == b.cut.tolist()
        assert np.allclose(a.weights, b.weights)
    assert len({tuple(t.feature.tolist()) for t in one.trees}) > 6  # rows and features are drawn
    longer = T.fit_trees(df, 20, max_depth=8, min_leaf=2, key=F.col("key"))
    assert all(a.cut.tolist() == b.cut.tolist() for a, b in zip(one.trees, longer.trees, strict=False))


def test_forest_beats_chance_and_its_trees(spark):
    x, y = noisy(1500, seed=7, classes=2)
    train = frame(spark, x[:1000], y[:1000])
    test = frame(spark, x[1000:], y[1000:])
    share = lambda m: test.select(F.avg((m.predicted() == F.col("label_idx")).cast("int"))).first()[0]
    assert share(T.fit_trees(train, 30, min_leaf=3)) > 0.75
    assert share(T.fit_trees(train, max_depth=4)) > 0.75


def test_drawn_weights_are_poisson():
    spec = T.TreeSpec(seed=9)
    w = T.row_weights(np.arange(100_000), np.zeros(100_000, dtype=np.int64), spec)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert (T.row_weights(np.arange(8), np.arange(8), T.TreeSpec(holdout=1)) == [1, 1, 0, 0, 1, 1, 0, 0]).all()


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert T.fit_trees(none).trees[0].feature.tolist() == [-1]
    same = frame(spark, np.ones((5, 2)), np.array([0, 1, 0, 1, 0]))
    assert T.fit_trees(same).trees[0].feature.tolist() == [-1] and T.fit_trees(same, 3).trees[2].feature.tolist() == [-1]
    wide = frame(spark, np.arange(3000.0)[:, None], (np.arange(3000) >= 1234).astype(int))
    model = T.fit_trees(wide)  # more values than bins: bounds at quantiles
    assert len(model.cuts[0]) == 255 and wide.where(model.predicted() != F.col("label_idx")).count() < 15


def test_search_leaves_trees_to_the_tasks(spark, monkeypatch):
    """Scores of forests and trees, in several blocks, against votes of the same trees; the search's driver holds none."""
    from granary.plans import families as P

    x, y = noisy(400, seed=11)
    df = frame(spark, x, y).withColumn("test_0", F.col("key") % 5 == 0).withColumn("test_1", F.col("key") % 3 == 0)
    matrix = P.Matrix(df, 3, 3, "key", {0: "test_0", 1: "test_1"})
    limits = [("n_estimators", 3, 7), ("max_depth", 4, 9), ("min_samples_split", 2, 9), ("min_samples_leaf", 1, 3)]
    combos = {i: {name: v[i >> at & 1] for at, (name, *v) in enumerate(limits)} for i in range(16)}
    cuts = T.cut_points(df, 3)
    rows = T.binned(df, cuts, matrix.held(), F.xxhash64("key"), "features", "label_idx").localCheckpoint()
    all_rows = T.Rows(*map(list, zip(*[tuple(r) for r in rows.collect()], strict=True)), 3)
    want = {}
    for forest in (False, True):
        for combo, p in combos.items():
            leaf, depth, split, most = P.tree_params(p, forest)
            for holdout in (0, 1):
                specs = [T.TreeSpec(leaf, split, depth, holdout, 42 + t if forest else None) for t in range(most)]
                trees, own = T.grow_trees(rows, specs, 3, 3) if (combo, holdout) in ((0, 0), (15, 1)) else None, all_rows.held >> holdout & 1 == 1
                if trees:
                    found = [p for _, p in T.votes(trees, all_rows.bins[own], depth, split, [most])][0]
                    pairs = [(combo, holdout, int(a), int(b), 1) for a, b in zip(all_rows.label[own], found, strict=True)]
                    want[(forest, combo, holdout)] = P.scored(spark.createDataFrame(pairs, P.COUNTS))[(combo, holdout)]
    monkeypatch.setattr(P, "FOREST_TREES", 14)
    made, whole = [], T.Tree.__post_init__
    monkeypatch.setattr(T.Tree, "__post_init__", lambda self: (made.append(1), whole(self))[1])
    for forest in (False, True):
        got = P.trees_of(matrix, combos, forest)
        assert len(got) == 32
        for (of, combo, holdout), f1 in want.items():
            if of == forest:
                assert got[(combo, holdout)] == pytest.approx(f1, abs=1e-12)
    assert not made


def test_rows_of_few_bytes_lie_in_many_tasks(spark):
    x, y = noisy(300)
    df = frame(spark, x, y).coalesce(1)
    table = T.binned(df, T.cut_points(df, 3), F.lit(0), F.xxhash64("key"), "features", "label_idx")
    assert table.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def celled(spark, n=3000):
    """Rows in few cells, most of them in one; two holdouts."""
    x, y = noisy(n, seed=13, classes=2)
    x[: 2 * n // 3] = x[0]
    y[: n // 2] = 1
    df = frame(spark, x, y)
    held = F.when(F.col("key") % 5 == 0, 1).otherwise(0) + F.when(F.col("key") % 3 == 0, 2).otherwise(0)
    return df, T.binned(df, T.cut_points(df, 3), held, F.xxhash64("key"), "features", "label_idx").localCheckpoint()


def test_rows_in_few_cells_need_no_pass_per_level(spark, monkeypatch):
    """More rows than a task may hold, in fewer cells: the nodes that passes per level give, without them."""
    _df, rows = celled(spark)
    specs = [T.TreeSpec(leaf, 4, 9, holdout, seed) for leaf in (1, 6) for holdout in (-1, 0, 1) for seed in (None, 42, 43)]
    cells = T.few_cells(rows, 3)
    assert 600 < len(cells) < 1200 and cells == sorted({(bytes(r["bins"]), r["label"]) for r in rows.collect()})
    by_level: dict = {}
    for r in T.tree_parts(rows, specs, 3, 2, 1200).collect():
        by_level.setdefault(r["tree"], []).append(list(r[1:]))

    def no_pass(*_):
        raise AssertionError("a pass over all rows for a level")

    monkeypatch.setattr(T, "_level_sums", no_pass)
    for i, got in enumerate(T.grow_trees(rows, specs, 3, 2, small_node=1200)):
        want = T.tree_of(by_level[i], 2)
        assert len(want.node) > 20 and want.n[0] > 1200
        for column in ("node", "feature", "cut", "n", "weights"):
            assert (getattr(got, column) == getattr(want, column)).all()


def test_scores_are_those_of_the_way_by_rows(spark, monkeypatch):
    """All forests of a search at once from their cells, against groups of them from their rows."""
    from granary.plans import families as P

    df, _rows = celled(spark, 900)
    matrix = P.Matrix(df.withColumn("test_0", F.col("key") % 5 == 0).withColumn("test_1", F.col("key") % 3 == 0), 3, 2, "key", {0: "test_0", 1: "test_1"})
    combos = {i: {"n_estimators": t, "max_depth": d, "min_samples_leaf": leaf} for i, (t, d, leaf) in enumerate([(3, 9, 1), (6, 9, 1), (6, 3, 1), (5, 9, 4)])}
    calls, real = [], P.tree_parts
    monkeypatch.setattr(P, "FOREST_TREES", 6)
    monkeypatch.setattr(P, "tree_parts", lambda rows, specs, *a, **k: (calls.append(len(specs)), real(rows, specs, *a, **k))[1])
    got = {forest: P.trees_of(matrix, combos, forest) for forest in (True, False)}
    assert calls == [22, 4]
    monkeypatch.setattr(T, "FEW_CELLS", 0)
    for forest, found in got.items():
        by_rows = P.trees_of(matrix, combos, forest)
        assert found.keys() == by_rows.keys() and all(v == pytest.approx(by_rows[k], abs=1e-12) for k, v in found.items())
    assert calls[2:] == [6, 6, 5, 5, 4]


def test_weights_are_those_of_the_chances():
    row = np.random.default_rng(5).integers(-(1 << 63), (1 << 63) - 1, 300_000)
    for seed in (0, 42, 241):
        assert (T.poisson_weights(row, seed) == np.searchsorted(T.POISSON, T.drawn(row, seed), "right")).all()


def test_a_search_works_on_rows_of_few_bytes_in_many_tasks(spark):
    from granary.plans.search import prepare_search_table

    df = spark.range(400).selectExpr("id", "if(id % 3 = 0, 'a', 'b') as Label", "cast(id % 7 as double) as x").coalesce(1)
    table = prepare_search_table(df, "id", 2, features=["x"])
    assert len(table.inputFiles()) > 1 and table.count() == 400
    assert table.where("test_0").count() == 80 and table.where("tree_test_1").count() == 120
