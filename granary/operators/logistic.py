"""Logistic regressions with an L2 penalty, many at once: one pass over the rows per step for all of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.trees import matrix_of

#: Pairs of steps that a quasi-Newton step looks back on; largest gradient entry at the end, least step.
MEMORY, TOLERANCE, LEAST_STEP = 10, 1e-7, 1e-12


@dataclass(frozen=True)
class LogisticSpec:
    """``C`` as the inverse weight of half the squared coefficients beside the summed loss; rows of bit ``holdout`` unseen."""

    C: float
    holdout: int = -1


def linear_scores(x: np.ndarray, w: np.ndarray, classes: int) -> np.ndarray:
    """Scores per class; two classes have one vector of coefficients, the last entry of a vector is its bias."""
    z = x @ w[:, :-1].T + w[:, -1]
    return np.column_stack([np.zeros(len(z)), z[:, 0]]) if classes == 2 else z


def loss_and_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int) -> tuple[float, np.ndarray]:
    z = linear_scores(x, w, classes)
    top = z.max(axis=1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(axis=1, keepdims=True)
    loss = float((np.log(total[:, 0]) + top[:, 0] - z[np.arange(len(y)), y]).sum())
    p = e / total
    p[np.arange(len(y)), y] -= 1
    p = p[:, 1:] if classes == 2 else p
    return loss, np.column_stack([p.T @ x, p.sum(axis=0)])


class Descent:
    """One model's way down: limited-memory quasi-Newton steps, halved until the loss falls enough."""

    def __init__(self, shape: tuple[int, int], limits: list[int]):
        self.w, self.f, self.g = np.zeros(shape), None, None
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.limits, self.at_limit = sorted(set(limits)), {}
        self.steps, self.size = 0, 1.0
        self.direction: np.ndarray | None = None
        self.done = False

    def trial(self) -> np.ndarray:
        return self.w if self.direction is None else self.w + self.size * self.direction

    def told(self, f: float, g: np.ndarray) -> None:
        """Loss and gradient at ``trial``."""
        if self.direction is not None:
            if not f <= self.f + 1e-4 * self.size * float((self.g * self.direction).sum()):
                self.size /= 2
                if self.size < LEAST_STEP:
                    self._end()
                return
            s, y = self.size * self.direction, g - self.g
            if float((s * y).sum()) > 1e-14:
                self.pairs = [*self.pairs, (s, y)][-MEMORY:]
            self.w = self.w + s
            self.steps += 1
            for limit in [m for m in self.limits if m == self.steps]:
                self.at_limit[limit] = self.w
        self.f, self.g = f, g
        if np.abs(g).max(initial=0) <= TOLERANCE or self.steps >= self.limits[-1]:
            self._end()
            return
        self.direction = -self._scaled(g)
        self.size = 1.0 if self.pairs else 1.0 / max(1.0, float(np.sqrt((g * g).sum())))

    def _scaled(self, g: np.ndarray) -> np.ndarray:
        q, factors = g.copy(), []
        for s, y in reversed(self.pairs):
            a = float((s * q).sum()) / float((s * y).sum())
            factors.append(a)
            q -= a * y
        if self.pairs:
            s, y = self.pairs[-1]
            q *= float((s * y).sum()) / float((y * y).sum())
        for (s, y), a in zip(self.pairs, reversed(factors), strict=True):
            q += s * (a - float((y * q).sum()) / float((s * y).sum()))
        return q

    def _end(self) -> None:
        self.done = True
        for limit in self.limits:
            self.at_limit.setdefault(limit, self.w)


def summed(table: DataFrame, points: dict[int, tuple[int, np.ndarray]], width: int, classes: int) -> dict[int, tuple[float, float, np.ndarray]]:
    """Rows, loss and gradient of each point (holdout, w) over the rows (features, label, held) that it sees."""
    holdouts = sorted({holdout for holdout, _ in points.values()})

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {i: np.zeros(2 + w.size) for i, (_, w) in points.items()}
        for batch in batches:
            x = matrix_of(batch.column(0), width)
            y, held = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2))
            for holdout in holdouts:
                seen = slice(None) if holdout < 0 else (held >> holdout) & 1 == 0
                for i, (own, w) in points.items():
                    if own == holdout:
                        loss, gradient = loss_and_gradient(x[seen], y[seen], w, classes)
                        total[i] += np.concatenate([[len(y[seen]), loss], gradient.ravel()])
        rows = [(i, at, v) for i, values in total.items() for at, v in enumerate(values.tolist())]
        columns = zip(*rows, strict=True) if rows else [()] * 3
        kinds = (pa.int32(), pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["i", "at", "x"])

    cells = table.select("features", "label", "held").mapInArrow(sums, "i int, at int, x double")
    out = {i: np.zeros(2 + w.size) for i, (_, w) in points.items()}
    for r in cells.groupBy("i", "at").agg(F.sum("x").alias("x")).collect():
        out[r["i"]][r["at"]] = r["x"]
    return {i: (v[0], v[1], v[2:].reshape(points[i][1].shape)) for i, v in out.items()}


def fit_logistic_models(
    table: DataFrame, specs: dict[LogisticSpec, list[int]], width: int, classes: int
) -> dict[tuple[LogisticSpec, int], np.ndarray]:
    """Coefficients per spec and limit of steps; ``table`` has features, label (int) and held (bits), written.

    Each pass sums what all models ask for, so their number changes the work of a pass, not the passes.
    """
    shape = (1 if classes <= 2 else classes, width + 1)
    ways = [(spec, Descent(shape, limits)) for spec, limits in specs.items()]
    while True:
        points = {i: (spec.holdout, way.trial()) for i, (spec, way) in enumerate(ways) if not way.done}
        if not points:
            break
        for i, (rows, loss, gradient) in summed(table, points, width, max(2, classes)).items():
            spec, way = ways[i]
            w = points[i][1]
            shrink = 1 / (spec.C * max(rows, 1))
            plain = np.column_stack([w[:, :-1], np.zeros(len(w))])
            way.told(loss / max(rows, 1) + shrink / 2 * float((plain**2).sum()), gradient / max(rows, 1) + shrink * plain)
    return {(spec, limit): w for spec, way in ways for limit, w in way.at_limit.items()}
