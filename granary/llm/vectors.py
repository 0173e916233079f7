"""Whole-number vectors in packed blocks, and exact products between two blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.plans.ranks import add_rank

#: Sums of products below this are exact in double precision.
EXACT = float(1 << 53)
BLOCK = "dim long, block long, n long, ids binary, starts binary, tags binary, vectors binary"


def whole_vectors(vectors: DataFrame, factor: int, *others: str) -> DataFrame:
    """vec_id, ``vector`` (``floor(factor * x)`` of every component x, as double), ``dim``, and the columns ``others``.

    Rows with a null id, or a vector that is null or holds a null or non-finite component, are left out;
    repeated rows count once. Components must stay below ``2**63 / factor``.
    """
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(factor))))
    sound = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    rows = sound.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"), F.size("embedding").cast("long").alias("dim"), *others)
    return rows.dropDuplicates()


def in_blocks(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """``rows`` with ``block``: ``size`` rows of one ``dim`` each, along ``order``."""
    ranked = add_rank(rows, ["dim"], ["dim", *order], "_rank")
    return ranked.withColumn("block", F.expr(f"cast((_rank - 1) div {size} as long)"))


def pack(frame: pd.DataFrame) -> pd.DataFrame:
    """One row for a block: the rows' vectors, ``tag`` numbers and lists of ids, end to end in the order of ``_rank``."""
    frame = frame.sort_values("_rank", ignore_index=True)
    counts = [len(i) for i in frame["ids"]]
    flat = {
        "ids": np.concatenate(frame["ids"].to_numpy()).astype(np.int64),
        "starts": np.concatenate([[0], np.cumsum(counts)]).astype(np.int64),
        "tags": frame["tag"].to_numpy(np.int64),
        "vectors": np.stack(frame["vector"]).astype(np.int64),
    }
    head = {"dim": [frame["dim"].iat[0]], "block": [frame["block"].iat[0]], "n": [len(frame)]}
    return pd.DataFrame(head | {k: [v.tobytes()] for k, v in flat.items()})


def packed(rows: DataFrame) -> DataFrame:
    """``BLOCK`` rows from (dim, block, _rank, ids, tag, vector); blocks have a bounded number of rows."""
    plain = rows.select("dim", "block", "_rank", "ids", F.col("tag").cast("long").alias("tag"), "vector")
    return plain.groupBy("dim", "block").applyInPandas(pack, BLOCK)


class Block:
    """A packed block, opened."""

    def __init__(self, row):
        self.n, self.dim = int(row.n), int(row.dim)
        read = lambda raw: np.frombuffer(raw, np.int64)
        self.ids, self.starts, self.tags = read(row.ids), read(row.starts), read(row.tags)
        self.vectors = read(row.vectors).reshape(self.n, self.dim)
        self.largest = float(np.abs(self.vectors.astype(np.float64)).max(initial=0))

    def members(self, i: int) -> np.ndarray:
        return self.ids[self.starts[i] : self.starts[i + 1]]

    def first_ids(self) -> np.ndarray:
        return self.ids[self.starts[:-1]]


def products(left: Block, right: Block, rows: slice = slice(None)) -> np.ndarray:
    """Inner products of all vectors of ``left`` with ``rows`` of ``right``: exact, as doubles where they hold them."""
    a, b = left.vectors, right.vectors[rows]
    if left.largest * right.largest * max(1, left.dim) < EXACT:
        return a.astype(np.float64) @ b.astype(np.float64).T
    if not left.dim:
        return np.zeros((len(a), len(b)))
    return a.astype(object) @ b.astype(object).T
