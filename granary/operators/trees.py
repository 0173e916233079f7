"""Decision trees and forests, grown level by level on binned features.

Nodes with many rows are split by sums over (node, feature, bin, class), one pass over the rows per
level for all trees at once. A node with few rows is grown to its end in one task, from its rows. Where the
rows lie in few cells (bins of all features, and a class), whole trees are grown from sums over these cells:
one pass makes them for all trees, a draw of rows serves all holdouts, and trees that see the same rows share
their sums. Both ways give the same nodes. Every node keeps its row count and class weights, so that a tree of
a smaller depth or a larger split size is read from the same nodes: both only stop a path earlier. Leaf size
changes the splits themselves.

A node is split when it has at least ``min_split`` rows of more than one class above ``max_depth``, at the
cut of the least weighted Gini impurity that leaves ``min_leaf`` rows on either side; of equal cuts the one of
the first feature, then the lowest. A forest draws its rows with Poisson(1) weights, and per node the
features that may split it; row counts are of distinct rows, as weights do not count for the limits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.session import in_many_tasks, written

MAX_BINS = 256
#: Rows of a node that one task may hold; trees of a group that start from the same rows.
SMALL_NODE, TREES_TOGETHER = 50_000, 25
#: Cells whose sums a task may hold, and their bytes.
FEW_CELLS, CELL_BYTES = 50_000, 8 << 20
#: Draws of rows whose trees a task grows.
UNITS_OF_TASK = 8
#: Rows that a task works on at a time; cells up to which it sums them in place.
BLOCK_ROWS, MOST_CELLS = 100_000, 1 << 22
BINNED = "bins binary, label int, row long, held long"
NODES = "tree int, node long, feature int, cut int, n long, weights array<double>"
#: Nodes of a tree, or of a part of it, as the bytes of one array per column.
PARTS = "tree int, node binary, feature binary, cut binary, n binary, weights binary"
PART_KINDS = {"node": np.int64, "feature": np.int32, "cut": np.int16, "n": np.int64, "weights": np.float64}


@dataclass(frozen=True)
class TreeSpec:
    """What a tree is grown with; ``holdout`` is the bit of the rows that it does not see, -1 for none."""

    min_leaf: int = 1
    min_split: int = 2
    max_depth: int = 30
    holdout: int = -1
    seed: int | None = None  # of the drawn rows and features; None takes all


@dataclass
class Tree:
    """Nodes in ascending order of their number; the children of node i are 2 i and 2 i + 1."""

    node: np.ndarray
    feature: np.ndarray  # -1 for a leaf
    cut: np.ndarray  # rows whose bin is not above go to the left
    n: np.ndarray
    weights: np.ndarray
    left: np.ndarray = field(init=False)

    def __post_init__(self):
        inner = self.feature >= 0
        self.left = np.zeros(len(self.node), dtype=np.int64)
        self.left[inner] = np.searchsorted(self.node, 2 * self.node[inner])

    def shares(self) -> np.ndarray:
        """Shares of the classes per node."""
        return self.weights / np.maximum(self.weights.sum(axis=1), 1e-300)[:, None]

    def reached(self, bins: np.ndarray, max_depth: int, min_split: int) -> np.ndarray:
        """Index of the node where each row ends with these limits."""
        at = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        goes_on = (self.feature >= 0) & (self.n >= min_split)
        for _ in range(max_depth):
            rows = rows[goes_on[at[rows]]]
            if not rows.size:
                break
            now = at[rows]
            right = bins[rows, self.feature[now]] > self.cut[now]
            at[rows] = self.left[now] + right
        return at


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def drawn(x: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) per value, the same wherever it is computed."""
    start = mixed(np.array([seed + 1], dtype=np.uint64))
    return (mixed(x.astype(np.int64).view(np.uint64) + start) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


#: Chances that a Poisson(1) weight is at most 0, 1, 2 ..., and the first of the 2^53 draws beyond each.
POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 16)])))
BEYOND = np.ceil(POISSON * float(1 << 53)).astype(np.uint64)
#: The weight by the first 16 bits of a draw, 255 where these do not tell.
_FIRST = np.arange(1 << 16, dtype=np.uint64) << np.uint64(37)
_LEAST, _MOST = (np.searchsorted(BEYOND, x, "right") for x in (_FIRST, _FIRST + np.uint64((1 << 37) - 1)))
BY_FIRST_BITS = np.where(_LEAST == _MOST, _LEAST, 255).astype(np.uint8)
#: A weight as the lower 32 bits of a number whose upper ones count the rows of any weight.
COUNTED = np.array([w + ((w > 0) << 32) for w in range(len(POISSON) + 1)], dtype=np.int64)


def poisson_weights(row: np.ndarray, seed: int) -> np.ndarray:
    """A Poisson(1) weight per number, by ``drawn``."""
    bits = mixed(row.astype(np.int64, copy=False).view(np.uint64) + mixed(np.array([seed + 1], dtype=np.uint64)))
    weights = BY_FIRST_BITS[bits >> np.uint64(48)]
    unsure = np.flatnonzero(weights == 255)
    weights[unsure] = np.searchsorted(BEYOND, bits[unsure] >> np.uint64(11), "right")
    return weights


def row_weights(row: np.ndarray, held: np.ndarray, spec: TreeSpec) -> np.ndarray:
    weights = np.ones(len(row)) if spec.seed is None else poisson_weights(row, spec.seed).astype(np.float64)
    if spec.holdout >= 0:
        weights[(held >> spec.holdout) & 1 == 1] = 0
    return weights


def allowed_features(varies: np.ndarray, nodes: np.ndarray, seed: int) -> np.ndarray:
    """Per node the first of its features in a drawn order that vary in it, as many as the root of their number."""
    width = varies.shape[1]
    most = max(1, int(np.sqrt(width)))
    keys = drawn((nodes[:, None] * width + np.arange(width)[None, :]).ravel(), seed + 7919).reshape(varies.shape)
    order = np.argsort(np.where(varies, keys, 2.0), axis=1, kind="stable")
    allowed = np.zeros_like(varies)
    np.put_along_axis(allowed, order[:, :most], True, axis=1)
    return allowed & varies


def best_cuts(at, bins, label, weight, n, nodes: int, classes: int, min_leaf: int):
    """Per node: best score and cut of one feature, and whether the feature varies in it.

    Rows, or sums of rows, lie in node ``at`` (all nodes have some). The score is the sum of squared
    class weights over their total on either side, which is largest where the Gini impurity is least.
    """
    key = at * MAX_BINS + bins
    order = np.argsort(bins.astype(np.uint8), kind="stable")  # numbers of up to two bytes are sorted by counting
    order = order[np.argsort(at[order].astype(np.uint16 if nodes <= 1 << 16 else np.int64), kind="stable")]
    key, at = key[order], at[order]
    sums = np.zeros((len(key), classes))
    sums[np.arange(len(key)), label[order]] = weight[order]
    sums, rows = np.cumsum(sums, axis=0), np.cumsum(n[order])
    last = np.searchsorted(at, np.arange(nodes), "right") - 1
    until, rows_until = sums[last], rows[last]
    base = np.concatenate([np.zeros((1, classes)), until[:-1]])
    rows_base = np.concatenate([[0], rows_until[:-1]])
    step = np.flatnonzero((key[1:] != key[:-1]) & (at[1:] == at[:-1]))
    own = at[step]
    varies = np.zeros(nodes, dtype=bool)
    varies[own] = True
    left, rows_left = sums[step] - base[own], rows[step] - rows_base[own]
    right, rows_right = until[own] - sums[step], rows_until[own] - rows[step]
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (left**2).sum(axis=1) / left.sum(axis=1) + (right**2).sum(axis=1) / right.sum(axis=1)
    score = np.where((rows_left >= min_leaf) & (rows_right >= min_leaf), score, -np.inf)
    best = np.full(nodes, -np.inf)
    np.maximum.at(best, own, score)
    first = np.flatnonzero((score == best[own]) & np.isfinite(score))[::-1]
    cut = np.full(nodes, -1, dtype=np.int64)
    cut[own[first]] = key[step[first]] % MAX_BINS
    return best, cut, varies


def chosen_splits(at, bins, label, weight, n, nodes: np.ndarray, classes: int, spec: TreeSpec) -> tuple[np.ndarray, np.ndarray]:
    """Feature (-1 for none) and cut per node; ``bins`` gives (rows, values) of each feature."""
    width = len(bins)
    score = np.full((len(nodes), width), -np.inf)
    cut = np.full((len(nodes), width), -1, dtype=np.int64)
    varies = np.zeros((len(nodes), width), dtype=bool)
    for f, (rows, values) in enumerate(bins):
        score[:, f], cut[:, f], varies[:, f] = best_cuts(
            at[rows], values, label[rows], weight[rows], n[rows], len(nodes), classes, spec.min_leaf
        )
    if spec.seed is not None:
        score[~allowed_features(varies, nodes, spec.seed)] = -np.inf
    feature = score.argmax(axis=1)
    line = np.arange(len(nodes))
    feature[~np.isfinite(score[line, feature])] = -1
    return feature, np.where(feature >= 0, cut[line, feature], -1)


def grown(
    bins: np.ndarray, label: np.ndarray, weight: np.ndarray, classes: int, spec: TreeSpec, root: int = 1, rows: np.ndarray | None = None
) -> dict[str, np.ndarray]:
    """All nodes below ``root`` of a tree over these rows, level by level; or over sums of so many ``rows`` each."""
    some = np.flatnonzero(weight > 0)
    bins, label, weight = bins[some].astype(np.int64), label[some], weight[some]
    ones = np.ones(len(some), dtype=np.int64) if rows is None else rows[some]
    nodes, at = np.array([root], dtype=np.int64), np.zeros(len(some), dtype=np.int64)
    depth = root.bit_length() - 1
    out: list[tuple] = []
    while nodes.size:
        weights = np.bincount(at * classes + label, weights=weight, minlength=len(nodes) * classes).reshape(-1, classes)
        n = np.bincount(at, weights=ones, minlength=len(nodes)).astype(np.int64)
        feature, cut = np.full(len(nodes), -1, dtype=np.int64), np.full(len(nodes), -1, dtype=np.int64)
        wide = (n >= max(spec.min_split, 2)) & ((weights > 0).sum(axis=1) > 1) & (depth < spec.max_depth)
        open_nodes = np.flatnonzero(wide)
        if open_nodes.size:
            place = np.full(len(nodes), -1, dtype=np.int64)
            place[open_nodes] = np.arange(open_nodes.size)
            inside = np.flatnonzero(place[at] >= 0)
            now = place[at[inside]]
            every = slice(None)
            columns = [(every, bins[inside, f]) for f in range(bins.shape[1])]
            feature[open_nodes], cut[open_nodes] = chosen_splits(
                now, columns, label[inside], weight[inside], ones[inside], nodes[open_nodes], classes, spec
            )
        out.append((nodes, feature, cut, n, weights))
        split = np.flatnonzero(feature >= 0)
        place = np.full(len(nodes), -1, dtype=np.int64)
        place[split] = np.arange(split.size)
        stay = np.flatnonzero(place[at] >= 0)
        now = at[stay]
        right = bins[stay, feature[now]] > cut[now]
        bins, label, weight, ones, at = bins[stay], label[stay], weight[stay], ones[stay], 2 * place[now] + right
        nodes = (2 * nodes[split][:, None] + np.array([0, 1])).ravel()
        depth += 1
    return {k: np.concatenate([o[i] for o in out]) for i, k in enumerate(("node", "feature", "cut", "n", "weights"))}


def cut_points(df: DataFrame, width: int, features: str = "features") -> list[np.ndarray]:
    """Per feature the bounds of its bins: between all values if they are few, else at quantiles."""
    value = lambda i: F.get(features, F.lit(i))
    if not width:
        return []
    about = df.agg(*[F.approx_count_distinct(value(i), 0.02).alias(str(i)) for i in range(width)]).first()
    few = [about[str(i)] <= MAX_BINS * 0.9 for i in range(width)]
    shares = [q / MAX_BINS for q in range(1, MAX_BINS)]
    found = df.agg(
        *[(F.collect_set(value(i)) if few[i] else F.percentile_approx(value(i), shares, 10_000)).alias(str(i)) for i in range(width)]
    ).first()
    out = []
    for i in range(width):
        values = np.unique(np.array(found[str(i)] or [], dtype=np.float64))
        out.append((values[1:] + values[:-1]) / 2 if few[i] and len(values) <= MAX_BINS else values[: MAX_BINS - 1])
    return out


def in_bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """A value up to the first bound is in bin 0, up to the second in bin 1, and so on."""
    return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1).astype(np.uint8)


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column, which all have ``width`` entries."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def binned(df: DataFrame, cuts: list[np.ndarray], held: Column, row: Column, features: str, label: str) -> DataFrame:
    """``BINNED``: a byte per feature, the class, a number that draws the row, and the bits of its holdouts."""
    width = len(cuts)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                bins = in_bins(matrix_of(batch.column(0), width), cuts)
                columns = [pa.array([b.tobytes() for b in bins], pa.binary()), *batch.columns[1:]]
                yield pa.RecordBatch.from_arrays(columns, ["bins", "label", "row", "held"])

    plain = df.select(F.col(features), F.col(label).cast("int"), row.cast("long"), held.cast("long"))
    return in_many_tasks(plain).mapInArrow(put, BINNED)


class Rows:
    """A batch of ``BINNED`` rows as arrays."""

    def __init__(self, bins, label, row, held, width: int):
        self.bins = np.frombuffer(b"".join(bins), np.uint8).reshape(len(bins), width)
        self.label, self.row, self.held = (np.asarray(c, dtype=np.int64) for c in (label, row, held))

    @classmethod
    def of(cls, batch: pa.RecordBatch, width: int) -> Rows:
        return cls(batch.column(0).to_pylist(), *[c.to_numpy(zero_copy_only=False) for c in batch.columns[1:4]], width)


def joined_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches put together to blocks of about ``BLOCK_ROWS`` rows, none of them empty."""
    some: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(some).combine_chunks().to_batches()[0]

    for batch in batches:
        if batch.num_rows:
            some.append(batch)
        if sum(b.num_rows for b in some) >= BLOCK_ROWS:
            yield joined()
            some = []
    if some:
        yield joined()


def row_blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Rows]:
    """The rows of the batches in blocks of about ``BLOCK_ROWS``."""
    return (Rows.of(block, width) for block in joined_blocks(batches))


def cell_sums(code: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes below ``size`` that occur, their weights and their rows."""
    if size > MOST_CELLS:
        cells, which, n = np.unique(code, return_inverse=True, return_counts=True)
        return cells, np.bincount(which, weights=weight), n
    n = np.bincount(code, minlength=size)
    cells = np.flatnonzero(n)
    return cells, np.bincount(code, weights=weight, minlength=size)[cells], n[cells]


class _Growing:
    """Splits known so far of the trees that still have large nodes."""

    def __init__(self):
        self.splits: dict[int, dict[int, tuple[int, int]]] = {}

    def place(self, tree: int, bins: np.ndarray) -> np.ndarray:
        """Number of the node that each row has come to."""
        splits = self.splits.get(tree, {})
        at = np.ones(len(bins), dtype=np.int64)
        for node in sorted(splits):
            rows = np.flatnonzero(at == node)
            feature, cut = splits[node]
            at[rows] = 2 * node + (bins[rows, feature] > cut)
        return at


def _level_sums(
    table: DataFrame, growing: _Growing, slots: dict[tuple[int, int], int], specs: list[TreeSpec], width: int, classes: int
) -> DataFrame:
    """Rows and weights by (slot, feature, bin, class) of the open nodes, each a slot."""
    open_nodes: dict[int, list[int]] = {}
    for tree, node in sorted(slots):
        open_nodes.setdefault(tree, []).append(node)
    names = ["slot", "feature", "bin", "label", "weight", "n"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_blocks(batches, width):
            for tree, nodes in open_nodes.items():
                weight, own = row_weights(rows.row, rows.held, specs[tree]), np.array(nodes)
                at = growing.place(tree, rows.bins)
                where = np.minimum(np.searchsorted(own, at), len(own) - 1)
                inside = np.flatnonzero((own[where] == at) & (weight > 0))
                if not inside.size:
                    continue
                base, weight = where[inside] * (MAX_BINS * classes) + rows.label[inside], weight[inside]
                of_slot, parts = np.array([slots[(tree, node)] for node in nodes]), []
                for f in range(width):
                    code = base + rows.bins[inside, f].astype(np.int64) * classes
                    cells, total, n = cell_sums(code, weight, len(own) * MAX_BINS * classes)
                    place = cells // classes
                    parts.append((of_slot[place // MAX_BINS], np.full(len(cells), f), place % MAX_BINS, cells % classes, total, n))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names)

    cells = table.mapInArrow(sums, "slot long, feature long, bin long, label long, weight double, n long")
    return cells.groupBy("slot", "feature", "bin", "label").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))


def _level_splits(cells: DataFrame, slots: dict[tuple[int, int], int], specs: list[TreeSpec], width: int, classes: int) -> pd.DataFrame:
    """Per slot: rows, class weights, and the chosen feature and cut."""
    names = {slot: place for place, slot in slots.items()}

    def choose(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        tree, node = names[int(key[0])]
        spec = specs[tree]
        at = np.zeros(len(frame), dtype=np.int64)
        label, weight, n = frame["label"].to_numpy(), frame["weight"].to_numpy(), frame["n"].to_numpy()
        of = [np.flatnonzero((frame["feature"] == f).to_numpy()) for f in range(width)]
        weights = np.bincount(label[of[0]], weights=weight[of[0]], minlength=classes)
        rows, depth = int(n[of[0]].sum()), node.bit_length() - 1
        feature, cut = -1, -1
        if rows >= max(spec.min_split, 2) and (weights > 0).sum() > 1 and depth < spec.max_depth:
            bins = [(own, frame["bin"].to_numpy()[own]) for own in of]
            found = chosen_splits(at, bins, label, weight, n, np.array([node]), classes, spec)
            feature, cut = int(found[0][0]), int(found[1][0])
        left = 0
        if feature >= 0:
            own = of[feature]
            left = int(n[own][frame["bin"].to_numpy()[own] <= cut].sum())
        return pd.DataFrame(
            {"tree": [tree], "node": [node], "feature": [feature], "cut": [cut], "n": [rows], "weights": [weights], "n_left": [left]}
        )

    return cells.groupBy("slot").applyInPandas(choose, NODES + ", n_left long").toPandas()


def packed(found: dict[str, np.ndarray]) -> list[bytes]:
    """Nodes as the columns of ``PARTS`` behind the tree."""
    return [np.ascontiguousarray(found[c], kind).tobytes() for c, kind in PART_KINDS.items()]


def tree_of(parts: list[list[bytes]], classes: int) -> Tree:
    """The tree that these parts make up."""
    if not parts:  # no row at all
        return Tree(np.array([1]), np.array([-1]), np.array([-1]), np.array([0]), np.zeros((1, classes)))
    columns = [np.concatenate([np.frombuffer(p[i], kind) for p in parts]) for i, kind in enumerate(PART_KINDS.values())]
    order = np.argsort(columns[0], kind="stable")
    return Tree(*[c[order] for c in columns[:-1]], columns[-1].reshape(-1, classes)[order])


def grow_trees(
    table: DataFrame, specs: list[TreeSpec], width: int, classes: int, small_node: int = SMALL_NODE
) -> list[Tree]:
    """One tree per spec over a written ``BINNED`` table. The driver holds the trees, as for any fitted tree."""
    parts: dict[int, list] = {}
    cells = few_cells(table, width, small_node)
    for r in tree_parts(table, specs, width, classes, small_node, cells).collect():
        parts.setdefault(r["tree"], []).append(list(r[1:]))
    return [tree_of(parts.get(tree, []), classes) for tree in range(len(specs))]


def few_cells(table: DataFrame, width: int, most: int | None = None) -> list[tuple[bytes, int]] | None:
    """The different (bins, label) of a ``BINNED`` table in ascending order, None if they are more than ``most``."""
    most = min(FEW_CELLS if most is None else most, CELL_BYTES // (width + 4))
    found = table.select("bins", "label").distinct().limit(most + 1).collect()
    return None if len(found) > most else sorted((bytes(r["bins"]), r["label"]) for r in found)


def tree_parts(
    table: DataFrame, specs: list[TreeSpec], width: int, classes: int, small_node: int = SMALL_NODE, cells: list[tuple[bytes, int]] | None = None
) -> DataFrame:
    """``PARTS`` of one tree per spec over a written ``BINNED`` table; a tree without rows has none.

    With the ``few_cells`` of the table its trees are grown from sums over them. Without, the driver holds
    the nodes of more than ``small_node`` rows; tasks hold at most so many rows, or sums.
    """
    if cells:
        return _grown_cells(table, cells, specs, width, classes)
    growing, parts = _Growing(), []
    rows = table.count()
    waiting = {(tree, 1): rows for tree in range(len(specs))}
    small: list[tuple[int, int]] = []
    while waiting:
        small += [place for place, n in waiting.items() if n <= small_node]
        slots = {place: i for i, place in enumerate(p for p, n in waiting.items() if n > small_node)}
        if not slots:
            break
        found = _level_splits(_level_sums(table, growing, slots, specs, width, classes), slots, specs, width, classes)
        parts.append(found.drop(columns="n_left"))
        waiting = {}
        for r in found[found["feature"] >= 0].itertuples():
            growing.splits.setdefault(r.tree, {})[r.node] = (r.feature, r.cut)
            waiting[(r.tree, 2 * r.node)], waiting[(r.tree, 2 * r.node + 1)] = r.n_left, r.n - r.n_left
    large = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"tree": []})
    told = [(int(tree), *packed({**own, "weights": np.stack(own["weights"])})) for tree, own in large.groupby("tree")]
    out = table.sparkSession.createDataFrame(told, PARTS)
    return out.unionByName(_grown_small(table, growing, small, specs, width, classes)) if small else out


def _grown_small(
    table: DataFrame, growing: _Growing, small: list[tuple[int, int]], specs: list[TreeSpec], width: int, classes: int
) -> DataFrame:
    """``PARTS`` below the small nodes, each grown by one task; whole trees that see all rows share a task in groups.

    Rows go to a task as the bytes of arrays: to an inner node with their weights, to whole trees with what draws them.
    """
    roots = sorted(tree for tree, node in small if node == 1)
    groups = [[(t, 1) for t in roots[i : i + TREES_TOGETHER]] for i in range(0, len(roots), TREES_TOGETHER)]
    of_inner: dict[int, dict[int, int]] = {}
    tasks = groups + [[place] for place in sorted((tree, node) for tree, node in small if node != 1)]
    for task in range(len(groups), len(tasks)):
        tree, node = tasks[task][0]
        of_inner.setdefault(tree, {})[node] = task
    names = ["task", "bins", "label", "row", "held"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_blocks(batches, width):
            out: list[tuple] = []
            if groups:
                whole = (rows.bins.tobytes(), rows.label.astype(np.int32).tobytes(), rows.row.tobytes(), rows.held.tobytes())
                out += [(group, *whole) for group in range(len(groups))]
            for tree, tasks_of in of_inner.items():
                own, to = (np.array(x) for x in zip(*tasks_of.items(), strict=True))
                weight, at = row_weights(rows.row, rows.held, specs[tree]), growing.place(tree, rows.bins)
                where = np.minimum(np.searchsorted(own, at), len(own) - 1)
                inside = np.flatnonzero((own[where] == at) & (weight > 0))
                inside = inside[np.argsort(where[inside], kind="stable")]
                ends = np.searchsorted(where[inside], np.arange(len(own)), "right").tolist()
                for k, (start, end) in enumerate(zip([0, *ends], ends, strict=False)):
                    if end > start:
                        part = inside[start:end]
                        label, drawn_in = rows.label[part].astype(np.int32), weight[part].astype(np.uint8)
                        out.append((int(to[k]), rows.bins[part].tobytes(), label.tobytes(), drawn_in.tobytes(), b""))
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

    def grow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        task = int(key[0])
        bins = np.frombuffer(b"".join(frame["bins"]), np.uint8).reshape(-1, width)
        label = np.frombuffer(b"".join(frame["label"]), np.int32).astype(np.int64)
        out = []
        for tree, node in tasks[task]:
            if task < len(groups):
                row, held = (np.frombuffer(b"".join(frame[c]), np.int64) for c in ("row", "held"))
                weight = row_weights(row, held, specs[tree])
            else:
                weight = np.frombuffer(b"".join(frame["row"]), np.uint8).astype(np.float64)
            out.append((tree, *packed(grown(bins, label, weight, classes, specs[tree], node))))
        return pd.DataFrame(out, columns=["tree", *PART_KINDS])

    sent = table.mapInArrow(send, "task long, bins binary, label binary, row binary, held binary")
    # By number: Spark would take a few thousand rows for little work and give them to one task.
    dealt = sent.repartition(min(len(tasks), 4 * table.sparkSession.sparkContext.defaultParallelism), "task")
    return dealt.groupBy("task").applyInPandas(grow, PARTS)


def _grown_cells(table: DataFrame, cells: list[tuple[bytes, int]], specs: list[TreeSpec], width: int, classes: int) -> DataFrame:
    """``PARTS`` of whole trees, each grown by one task from its sums over the cells.

    Rows lie by cell, a cell of many rows in several tasks, so that a task sums few cells whatever the rows.
    """
    spark = table.sparkSession
    units: dict[tuple[int | None, int], list[int]] = {}
    for tree, spec in enumerate(specs):
        units.setdefault((spec.seed, spec.holdout), []).append(tree)
    of_unit, draws = list(units.values()), {}
    for unit, (seed, holdout) in enumerate(units):
        draws.setdefault(seed, []).append((unit, holdout))
    bins = np.frombuffer(b"".join(b for b, _ in cells), np.uint8).reshape(-1, width)
    labels = np.array([label for _, label in cells], dtype=np.int64)
    names = ["unit", "first", "sums"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in joined_blocks(batches):
            cell, row, held = (block.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            order = np.lexsort((held, cell))
            cell, row, held = cell[order], row[order], held[order]
            # Rows of one cell and one set of holdouts lie together; then these by cell.
            start = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (held[1:] != held[:-1])]))
            of_cell = np.flatnonzero(np.concatenate([[True], cell[start][1:] != cell[start][:-1]]))
            first, at = int(cell[0]), cell[start][of_cell] - cell[0]
            seen = {h: (held[start] >> h) & 1 == 0 for of_seed in draws.values() for _, h in of_seed if h >= 0}
            for seed, of_seed in draws.items():
                drawn_in = np.ones(len(row), dtype=np.uint8) if seed is None else poisson_weights(row, seed)
                total = np.add.reduceat(COUNTED[drawn_in], start)
                out = []
                for unit, holdout in of_seed:
                    here = np.zeros(int(at[-1]) + 1, dtype=np.int64)
                    here[at] = np.add.reduceat(total * seen[holdout] if holdout >= 0 else total, of_cell)
                    out.append((unit, first, here.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def grow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        weight, n = np.zeros(len(labels)), np.zeros(len(labels), dtype=np.int64)
        for first, part in zip(frame["first"], frame["sums"], strict=True):
            here = np.frombuffer(part, np.int64)
            weight[first : first + len(here)] += here & 0xFFFFFFFF
            n[first : first + len(here)] += here >> 32
        out = [(tree, *packed(grown(bins, labels, weight, classes, specs[tree], 1, n))) for tree in of_unit[int(key[0])]]
        return pd.DataFrame(out, columns=["tree", *PART_KINDS])

    kinds = (pa.int32(), pa.int32(), pa.binary())
    parallel = spark.sparkContext.defaultParallelism
    numbered = spark.createDataFrame([(b, label, i) for i, (b, label) in enumerate(cells)], "bins binary, label int, cell long")
    rows = table.join(F.broadcast(numbered), ["bins", "label"]).select("cell", "row", "held")
    by_cell = rows.repartitionByRange(max(2 * parallel, -(-table.count() // BLOCK_ROWS)), "cell", "row").sortWithinPartitions("cell")
    # Few trees per task, however few the cores: a reader of what is written holds those of a file.
    tasks = max(min(len(of_unit), 4 * parallel), -(-len(of_unit) // UNITS_OF_TASK))
    dealt = by_cell.mapInArrow(sums, "unit int, first int, sums binary").repartition(tasks, "unit")
    return dealt.groupBy("unit").applyInPandas(grow, PARTS)


def votes(trees: list[Tree], bins: np.ndarray, max_depth: int, min_split: int, stops: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """After each number of trees in ``stops``: the class of the largest mean share per row, the first of equal ones."""
    total = np.zeros((len(bins), trees[0].weights.shape[1]))
    for i, tree in enumerate(trees, 1):
        total += tree.shares()[tree.reached(bins, max_depth, min_split)]
        if i in stops:
            yield i, np.round(total, 9).argmax(axis=1)


@dataclass
class TreesModel:
    """A tree, or the trees of a forest, with the bounds of the bins they were grown on."""

    trees: list[Tree]
    cuts: list[np.ndarray]
    max_depth: int
    min_split: int

    def predicted(self, features: str = "features") -> Column:
        trees, cuts, depth, split = self.trees, self.cuts, self.max_depth, self.min_split

        @F.pandas_udf("double")
        def vote(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                x = np.stack(part) if len(part) else np.zeros((0, len(cuts)))
                found = [p for _, p in votes(trees, in_bins(x, cuts), depth, split, [len(trees)])][0]
                yield pd.Series(found.astype(np.float64))

        return vote(F.col(features))


def fit_trees(
    df: DataFrame,
    trees: int | None = None,
    max_depth: int = 30,
    min_split: int = 2,
    min_leaf: int = 1,
    seed: int = 42,
    features: str = "features",
    label: str = "label_idx",
    key: Column | None = None,
    small_node: int = SMALL_NODE,
) -> TreesModel:
    """A decision tree, or with ``trees`` a forest of so many.

    ``features`` is an array of numbers without holes, ``label`` a number from 0. ``key`` draws the rows of a
    forest; by default the row's content does, so that equal rows are drawn alike.
    """
    first = df.agg(F.max(F.size(features)).alias("width"), F.max(F.col(label).cast("int")).alias("most")).first()
    width, classes = first["width"] or 0, (first["most"] if first["most"] is not None else 0) + 1
    cuts = cut_points(df, width, features)
    row = F.xxhash64(F.col(features), F.col(label)) if key is None else F.xxhash64(key)
    table = written(binned(df, cuts, F.lit(0), row, features, label), "binned")
    specs = [TreeSpec(min_leaf, min_split, max_depth, -1, None if trees is None else seed + i) for i in range(trees or 1)]
    return TreesModel(grow_trees(table, specs, width, classes, small_node), cuts, max_depth, min_split)
