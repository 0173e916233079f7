"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import fold_of
from granary.llm.linear import isotonic
from granary.session import written

STATISTICS = (
    "log_words", "word_length", "word_length_spread", "longest_word", "distinct_words", "top_word", "word_twice",
    "repeated_trigrams", "symbols", "bars", "exclamations", "stops", "commas", "upper", "digits", "non_ascii",
    "log_lines", "line_words", "repeated_lines", "full_stop_lines", "upper_words", "symbol_words", "short_words", "entropy",
)
WORDS = re.compile(r"[^ \t\n\x0b\x0c\r]+")
FOLDS = 4
#: Bounds of what is fitted: labelled rows, random features, bins of the calibration.
LABELLED_ROWS, WAVES, BINS = 20_000, 384, 400
WIDTH, RIDGE = 2.5, 1.0


def statistics(text: str | None) -> np.ndarray:
    """The ``STATISTICS`` of a text, all finite; zeros for null and empty texts."""
    out = np.zeros(len(STATISTICS))
    words = WORDS.findall(text or "")
    if not words:
        return out
    n = len(words)
    lengths = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    ids = {w: i for i, w in enumerate(counts)}
    codes = np.fromiter((ids[w] for w in words), np.int64, n)
    trigrams = (codes[:-2] * 1_000_003 + codes[1:-1]) * 1_000_003 + codes[2:]
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    chars = raw.sum()
    lines = [x for x in text.split("\n") if x.strip()]
    shares = raw[raw > 0] / chars
    some = lambda s: raw[[ord(c) for c in s]].sum()
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    marked = sum(w[-1] in "#*$%&|<>" for w in words)
    out[:] = (
        np.log1p(n), lengths.mean(), lengths.std(), np.log1p(lengths.max()), len(counts) / np.sqrt(n),
        max(counts.values()) / n, (codes[1:] == codes[:-1]).mean() if n > 1 else 0,
        1 - np.unique(trigrams).size / trigrams.size if n > 2 else 0,
        some("#*$%&<>@^~=+_\\/{}[]") / chars, some("|") / n, some("!") / n, some(".") / n, some(",") / n,
        raw[65:91].sum() / chars, raw[48:58].sum() / chars, raw[128:].sum() / chars, np.log1p(len(lines)),
        np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
        sum(x.rstrip()[-1] in ".!?" for x in lines) / max(1, len(lines)), upper / n, marked / n,
        (lengths <= 3).mean(), -(shares * np.log(shares)).sum(),
    )
    return out


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    centres: np.ndarray
    levels: np.ndarray

    def expand(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, with a constant as the last column."""
        x = np.clip((stats - self.mean) / self.spread, -6, 6)
        z = np.sqrt(2 / self.waves.shape[1]) * np.cos(x @ self.waves + self.phases)
        return np.hstack([z, np.ones((len(z), 1))])

    def calibrated(self, ridge_scores: np.ndarray) -> np.ndarray:
        """Linear between the pooled blocks, so that the order of the ridge scores stays visible."""
        return np.clip(np.interp(ridge_scores, self.centres, self.levels), 0, 1)

    def score(self, texts) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        return self.calibrated(self.expand(np.stack([statistics(t) for t in texts])) @ self.weights)


def labelled_statistics(docs: DataFrame, labels: DataFrame, held_out: int, rows: int) -> DataFrame:
    """(stats, quality, half) of at most ``rows`` labelled documents outside the held-out fold, by a hash of the id."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .where(fold_of(F.col("doc_id"), FOLDS) != held_out)
        .groupBy("doc_id")
        .agg(F.min(F.col("quality").cast("int")).alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["quality", "half"]].assign(stats=[statistics(t) for t in frame["text"]])

    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "quality", half)
    return texts.mapInPandas(measure, "stats array<double>, quality int, half int")


def summed(df: DataFrame, terms) -> dict[tuple[int, int], float]:
    """``terms(frame)`` gives a matrix per batch; their sum over all partitions, by cell."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if len(frame):
                part = terms(frame)
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "x": total.ravel()})

    cells = df.mapInPandas(partial, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    return {(r["i"], r["j"]): r["x"] for r in cells.collect()}


def matrix(cells: dict[tuple[int, int], float], rows: int, columns: int) -> np.ndarray:
    out = np.zeros((rows, columns))
    for (i, j), x in cells.items():
        out[i, j] = x
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, held_out: int = 2) -> QualityModel:
    """Fits on labels outside the held-out fold; an id with several labels has the smallest.

    Every sum (moments, normal equations, calibration bins) is taken per partition and added up; the
    driver gets twice as many cells as the model has. The ridge is fitted on all rows; the calibration
    sees each half of the rows through a ridge fitted on the other half. Null ids and labels are left out; without any label
    every score is 0.5.
    """
    d = len(STATISTICS)
    sample = written(labelled_statistics(docs, labels, held_out, LABELLED_ROWS), "quality-statistics")

    def moments(frame: pd.DataFrame) -> np.ndarray:
        x = np.stack(frame["stats"])
        return np.stack([x.sum(axis=0), (x * x).sum(axis=0), np.full(d, len(x))])

    sums = matrix(summed(sample, moments), 3, d)
    n = max(1.0, sums[2, 0])
    mean = sums[0] / n
    spread = np.sqrt(np.maximum(sums[1] / n - mean**2, 0))
    random = np.random.default_rng(4)
    model = QualityModel(
        mean, np.where(spread > 1e-9, spread, 1.0), random.normal(0, 1 / WIDTH, (d, WAVES)),
        random.uniform(0, 2 * np.pi, WAVES), np.zeros(WAVES + 1), np.array([0.0]), np.array([0.5]),
    )
    if sums[2, 0] == 0:
        return model
    k = WAVES + 1

    def equations(frame: pd.DataFrame) -> np.ndarray:
        z, y, half = model.expand(np.stack(frame["stats"])), frame["quality"].to_numpy(np.float64), frame["half"].to_numpy()
        own = [(z[half == h], y[half == h]) for h in (0, 1)]
        return np.vstack([np.vstack([x.T @ x, t @ x]) for x, t in own])

    cells = matrix(summed(sample, equations), 2 * (k + 1), k).reshape(2, k + 1, k)
    shrink = np.diag(np.append(np.full(WAVES, RIDGE), 1e-6))
    solved = lambda c: np.linalg.solve(c[:k] + shrink, c[k])
    weights = solved(cells.sum(axis=0))
    unseen = np.stack([solved(cells[1]), solved(cells[0])])

    def bins(frame: pd.DataFrame) -> np.ndarray:
        ridge = (model.expand(np.stack(frame["stats"])) * unseen[frame["half"].to_numpy()]).sum(axis=1)
        s = np.clip(ridge, -0.5, 1.5)
        at = np.minimum(((s + 0.5) / 2 * BINS).astype(int), BINS - 1)
        out = np.zeros((3, BINS))
        np.add.at(out[0], at, s)
        np.add.at(out[1], at, frame["quality"].to_numpy(np.float64))
        np.add.at(out[2], at, 1)
        return out

    counted = matrix(summed(sample, bins), 3, BINS)
    counted = counted[:, counted[2] > 0]
    centres, levels = isotonic(counted[0] / counted[2], counted[1] / counted[2], counted[2])
    return QualityModel(model.mean, model.spread, model.waves, model.phases, weights, centres, levels)


def score_quality(docs: DataFrame, model: QualityModel, out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the probability that a text is good; a column of that name is replaced.

    Only the text decides, whole whatever its length. Null and empty texts have statistics of zero and
    the score that goes with them. Other columns and repeated rows pass through; a table without rows
    gives none.
    """

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(model.score(part.tolist()), dtype=np.float64)

    return docs.withColumn(out, score("text"))
