"""Scores of all combinations of a model over all holdouts, from passes that they share.

Naive Bayes takes the statistics of all holdouts from one aggregation and every smoothing from them.
Logistic regressions of all penalties and holdouts take their steps in common passes. Trees are grown
once per leaf size and holdout, from sums that the leaf sizes share where rows lie in few cells; depths,
split sizes and numbers of trees are read from the same nodes.
The predictions of all of them are counted in one pass per family, or per group of forests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.classifiers import VAR_SMOOTHING, GaussianModel
from granary.operators.evaluation import weighted_f1_of
from granary.operators.logistic import LogisticSpec, fit_logistic_models, linear_scores
from granary.operators.trees import (
    BLOCK_ROWS,
    MAX_BINS,
    PART_KINDS,
    TreeSpec,
    binned,
    cut_points,
    few_cells,
    matrix_of,
    mixed,
    row_blocks,
    tree_of,
    tree_parts,
)
from granary.session import written

#: Trees of forests that are grown and counted together.
FOREST_TREES = 500
DEEPEST_TREE = 60
COUNTS = "combo int, holdout int, actual long, predicted long, n long"
#: Predictions: (combination, holdout, classes of the held-out rows, predicted classes).
Predictions = Iterator[tuple[int, int, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Matrix:
    """Rows to fit on: features, label_idx, a key, and the flag column of each holdout by its number."""

    table: DataFrame
    width: int
    classes: int
    key: str
    flags: dict[int, str]

    def held(self) -> Column:
        """Bit i: the row is held out in holdout i."""
        bits = [F.when(F.col(flag), F.lit(1 << i)).otherwise(F.lit(0)) for i, flag in self.flags.items()]
        return sum(bits[1:], bits[0]).cast("long")


def counted(table: DataFrame, predict: Callable[[pa.RecordBatch], Predictions]) -> dict[tuple[int, int], float]:
    """Weighted F1 by (combination, holdout) of the predictions over all batches of ``table``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for combo, holdout, actual, predicted in predict(batch):
                pairs, n = np.unique(np.column_stack([actual, predicted]).astype(np.int64), axis=0, return_counts=True)
                columns = [np.full(len(n), combo, np.int32), np.full(len(n), holdout, np.int32), pairs[:, 0], pairs[:, 1], n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["combo", "holdout", "actual", "predicted", "n"])

    return scored(table.mapInArrow(count, COUNTS))


def scored(counts: DataFrame) -> dict[tuple[int, int], float]:
    """Weighted F1 by (combination, holdout) of ``COUNTS``."""
    by = ("combo", "holdout")
    cells = counts.groupBy(*by, "actual", "predicted").agg(F.sum("n").alias("n"))
    return {(r["combo"], r["holdout"]): float(r["f1"]) for r in weighted_f1_of(cells, by).collect()}


def plain_rows(matrix: Matrix) -> DataFrame:
    own = matrix.table.select("features", F.col("label_idx").cast("int").alias("label"), matrix.held().alias("held"))
    return written(own, "fit-rows")


def opened(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    label, held = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2))
    return matrix_of(batch.column(0), width), label, held


def bayes_models(rows: DataFrame, holdouts: list[int]) -> dict[int, GaussianModel]:
    """One model per holdout, from one aggregation over (holdout, class) of the rows that it sees."""
    seen = F.array(*[F.when(F.col("held").bitwiseAND(F.lit(1 << i).cast("long")) == 0, F.lit(i)) for i in holdouts])
    each = rows.withColumn("holdout", F.explode(F.array_compact(seen)))
    summary = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector("features"))
    found: dict[int, list] = {}
    for r in each.groupBy("holdout", "label").agg(summary.alias("s")).select("holdout", "label", "s.*").collect():
        found.setdefault(r["holdout"], []).append(r)
    models = {}
    for holdout, stats in found.items():
        stats.sort(key=lambda r: r["label"])
        counts = np.array([float(r["count"]) for r in stats])
        shrink = ((counts - 1) / counts)[:, None]  # the summarizer divides by n - 1
        models[holdout] = GaussianModel(
            [int(r["label"]) for r in stats], counts, np.array([r["mean"].toArray() for r in stats]),
            np.array([r["variance"].toArray() for r in stats]) * shrink,
        )
    return models


def naive_bayes(matrix: Matrix, combos: dict[int, dict]) -> dict[tuple[int, int], float]:
    smoothings = {combo: float(p.get("var_smoothing", VAR_SMOOTHING)) for combo, p in combos.items()}
    rows, width = plain_rows(matrix), matrix.width
    models = bayes_models(rows, list(matrix.flags))

    def predict(batch: pa.RecordBatch) -> Predictions:
        x, label, held = opened(batch, width)
        for holdout, model in models.items():
            own = (held >> holdout) & 1 == 1
            for combo, smoothing in smoothings.items():
                variances = model.variances + smoothing * model.largest_variance()
                score = np.log(model.counts / model.counts.sum()) - 0.5 * np.log(2 * np.pi * variances).sum(axis=1)
                gaps = [((x[own] - m) ** 2 / v).sum(axis=1) for m, v in zip(model.means, variances, strict=True)]
                best = (score[None, :] - 0.5 * np.column_stack(gaps)).argmax(axis=1)
                yield combo, holdout, label[own], np.array(model.labels)[best]

    return counted(rows, predict)


def logistic(matrix: Matrix, combos: dict[int, dict]) -> dict[tuple[int, int], float]:
    asked = {combo: (float(p.get("C", 1.0)), int(p.get("max_iter", 100))) for combo, p in combos.items()}
    rows, width, classes, holdouts = plain_rows(matrix), matrix.width, matrix.classes, list(matrix.flags)
    specs: dict[LogisticSpec, list[int]] = {}
    for holdout in holdouts:
        for c, limit in asked.values():
            specs.setdefault(LogisticSpec(c, holdout), []).append(limit)
    models = fit_logistic_models(rows, specs, width, classes)

    def predict(batch: pa.RecordBatch) -> Predictions:
        x, label, held = opened(batch, width)
        for combo, (c, limit) in asked.items():
            for holdout in holdouts:
                own = (held >> holdout) & 1 == 1
                scores = linear_scores(x[own], models[(LogisticSpec(c, holdout), limit)], max(2, classes))
                yield combo, holdout, label[own], scores.argmax(axis=1)

    return counted(rows, predict)


def tree_params(params: dict, forest: bool) -> tuple[int, int, int, int]:
    """(min_samples_leaf, max_depth, min_samples_split, trees); raises for what cannot be."""
    leaf, depth, split = (int(params.get(k, d)) for k, d in (("min_samples_leaf", 1), ("max_depth", DEEPEST_TREE), ("min_samples_split", 2)))
    trees = int(params.get("n_estimators", 100)) if forest else 1
    if leaf < 1 or split < 2 or depth < 1 or trees < 1 or depth > DEEPEST_TREE:
        raise ValueError(f"limits out of range (a depth is at most {DEEPEST_TREE}): {params}")
    return leaf, depth, split, trees


def trees_of(matrix: Matrix, combos: dict[int, dict], forest: bool, seed: int = 42) -> dict[tuple[int, int], float]:
    asked = {combo: tree_params(p, forest) for combo, p in combos.items()}
    cuts = cut_points(matrix.table, matrix.width)
    rows = written(
        binned(matrix.table, cuts, matrix.held(), F.xxhash64(F.col(matrix.key)), "features", "label_idx"), "binned"
    )
    width, scores = matrix.width, {}
    # One group of trees per leaf size and holdout; as many trees, and as wide limits, as any combination asks for.
    groups = []
    for leaf in sorted({a[0] for a in asked.values()}):
        own = [a for a in asked.values() if a[0] == leaf]
        depth, split, most = max(a[1] for a in own), min(a[2] for a in own), max(a[3] for a in own)
        for holdout in matrix.flags:
            groups.append((leaf, holdout, [TreeSpec(leaf, split, depth, holdout, seed + t if forest else None) for t in range(most)]))
    cells = few_cells(rows, width)
    # Sums over cells are small, and all forests draw the same rows: they are grown together.
    together = max(1, FOREST_TREES // max(len(g[2]) for g in groups)) if cells is None else len(groups)
    total = rows.count() if cells is None else len(cells)
    # To be voted on, with the number of equal rows in the place of what draws a row.
    equal = rows.withColumn("row", F.lit(1).cast("long"))
    if cells is not None:
        equal = rows.groupBy("bins", "label", "held").agg(F.count(F.lit(1)).alias("row")).select(*rows.columns)
    for at in range(0, len(groups), together):
        some = groups[at : at + together]
        parts = written(tree_parts(rows, [s for g in some for s in g[2]], width, matrix.classes, cells=cells), "tree-parts")
        scores |= voted(equal, total, parts, [(leaf, holdout, len(specs)) for leaf, holdout, specs in some], asked, width, matrix.classes)
    return scores


def voted(
    rows: DataFrame, total: int, parts: DataFrame, forests: list[tuple[int, int, int]], asked: dict[int, tuple], width: int, classes: int
) -> dict[tuple[int, int], float]:
    """Weighted F1 by (combination, holdout) of forests, each (leaf size, holdout, number of trees).

    ``parts`` numbers the trees of the first forest from 0, then those of the next. The held-out rows of a holdout
    are dealt to blocks, equal ones to the same; a block and a forest meet in one task, to which the trees come one
    after the other. ``row`` counts equal rows, and ``total`` is about the number of different ones.
    """
    spark = rows.sparkSession
    blocks = max(-(-total // BLOCK_ROWS), -(-2 * spark.sparkContext.defaultParallelism // len(forests)))
    units, names = len(forests) * blocks, ["unit", "at", "bins", "label", "rows"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in row_blocks(batches, width):
            code = np.zeros(len(own.label), dtype=np.uint64)
            for f in range(width):
                code = code * np.uint64(MAX_BINS + 1) + own.bins[:, f]
            block = mixed(code) % np.uint64(blocks)
            for holdout in sorted({f[1] for f in forests}):
                held = np.flatnonzero((own.held >> holdout) & 1 == 1)
                held = held[np.argsort(block[held], kind="stable")]
                ends = np.searchsorted(block[held], np.arange(blocks, dtype=np.uint64), "right").tolist()
                for b, (start, end) in enumerate(zip([0, *ends], ends, strict=False)):
                    if end == start:
                        continue
                    part = held[start:end]
                    to = [f * blocks + b for f, forest in enumerate(forests) if forest[1] == holdout]
                    content = [own.bins[part].tobytes(), own.label[part].tobytes(), own.row[part].tobytes()]
                    columns = [pa.array(to, pa.int32()), pa.array([-1] * len(to), pa.int32()), *[pa.array([c] * len(to)) for c in content]]
                    yield pa.RecordBatch.from_arrays(columns, names)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (line for batch in batches for i in range(batch.num_rows) for line in batch.slice(i, 1).to_pylist())
        for unit, of_unit in groupby(lines, lambda line: line["unit"]):
            leaf, holdout, _ = forests[unit // blocks]
            limits: dict[tuple[int, int], dict[int, list[int]]] = {}
            for combo, (own_leaf, depth, split, most) in asked.items():
                if own_leaf == leaf:
                    limits.setdefault((depth, split), {}).setdefault(most, []).append(combo)
            bins = label = n_rows = place = None
            shares: dict[tuple[int, int], np.ndarray] = {}
            out: list[tuple[int, np.ndarray]] = []

            def stop(until: float, left: dict = limits, out: list = out, shares: dict = shares) -> None:
                # Combinations of at most ``until`` trees have heard all of them.
                for limit, stops in left.items():
                    for most in [m for m in stops if m <= until]:
                        found = np.round(shares[limit], 9).argmax(axis=1)
                        out += [(combo, found) for combo in stops.pop(most)]

            for at, own in groupby(of_unit, lambda line: line["at"]):
                if at == -1:
                    pieces = [(line["bins"], line["label"], line["rows"]) for line in own]
                    bins = np.frombuffer(b"".join(p[0] for p in pieces), np.uint8).reshape(-1, width)
                    label, n_rows = (np.frombuffer(b"".join(p[i] for p in pieces), np.int64) for i in (1, 2))
                    # Rows of the same bins go the same way.
                    _, first, place = np.unique(bins.view(f"V{width}").ravel(), return_index=True, return_inverse=True)
                    bins = bins[first]
                    shares.update({limit: np.zeros((len(bins), classes)) for limit in limits})
                    continue
                if bins is None:  # nothing is held out here
                    continue
                stop(at)
                tree = tree_of([[line[c] for c in PART_KINDS] for line in own], classes)
                for (depth, split), stops in limits.items():
                    if stops:
                        shares[(depth, split)] += tree.shares()[tree.reached(bins, depth, split)]
            if bins is None:
                continue
            stop(np.inf)
            for combo, found in out:
                n = np.bincount(label * classes + found[place], weights=n_rows, minlength=classes * classes).astype(np.int64)
                pairs = np.flatnonzero(n)
                columns = [np.full(len(pairs), combo, np.int32), np.full(len(pairs), holdout, np.int32), pairs // classes, pairs % classes, n[pairs]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["combo", "holdout", "actual", "predicted", "n"])

    places = [(f, at) for f, forest in enumerate(forests) for at in range(forest[2])]
    of_tree = spark.createDataFrame([(tree, *place) for tree, place in enumerate(places)], "tree int, f int, at int")
    trees = parts.join(F.broadcast(of_tree), "tree").select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "f", "at", *PART_KINDS
    )
    trees = trees.select((F.col("f") * blocks + F.col("b")).alias("unit"), "at", *PART_KINDS)
    dealt = rows.mapInArrow(deal, "unit int, at int, bins binary, label binary, rows binary")
    met = dealt.unionByName(trees, allowMissingColumns=True).repartitionById(units, F.col("unit")).sortWithinPartitions("unit", "at")
    return scored(met.mapInArrow(vote, COUNTS))


def checked(model: str, params: dict) -> None:
    """Raises what a fit would raise for these parameters."""
    if model == "Naive Bayes":
        float(params.get("var_smoothing", VAR_SMOOTHING))
    elif model == "Logistic Regression":
        if float(params.get("C", 1.0)) <= 0 or int(params.get("max_iter", 100)) < 1:
            raise ValueError(f"C and max_iter must be above 0: {params}")
        if params.get("penalty", "l2") != "l2":
            raise ValueError(f"only the l2 penalty is built: {params}")
    elif model in ("Decision Tree", "Random Forest"):
        tree_params(params, model == "Random Forest")
    else:
        raise ValueError(f"unknown model {model}")


def family_scores(model: str, matrix: Matrix, combos: dict[int, dict]) -> dict[tuple[int, int], float]:
    """Weighted F1 by (combination, holdout); a holdout without rows scores 0."""
    if model == "Naive Bayes":
        found = naive_bayes(matrix, combos)
    elif model == "Logistic Regression":
        found = logistic(matrix, combos)
    else:
        found = trees_of(matrix, combos, model == "Random Forest")
    return {(combo, i): found.get((combo, i), 0.0) for combo in combos for i in matrix.flags}
