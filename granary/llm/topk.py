"""Exact search for the largest inner products, by vectors in buckets of similar length.

Distinct vectors are sorted by length and cut into buckets; a few buckets make a block. The block of
the longest vectors answers every query first: its k-th best product is a floor below which nothing
counts. A product is the cosine times both lengths, so floor and length of a bucket's longest vector
give the least cosine that can still count in it, its local threshold. A bucket that would need more
than 1 is left out, and a block of buckets not even sent to the query. Where the threshold is high,
the query's largest coordinates bound the candidates' coordinates and ranges of sorted columns are
intersected; where it is low, the vectors down to the least length are taken. The products of what
is left decide.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.vectors import Block, in_blocks, packed, products, whole_vectors
from granary.session import written

FACTOR = 1024
BUCKET_ROWS, BLOCK_ROWS, QUERY_BLOCK = 2048, 8192, 1024
#: Local cosine threshold from which coordinates prune; coordinates that are looked at then.
COORDINATE_FROM, FOCUS = 0.8, 4
#: Slack of comparisons that only leave work out.
SLACK = 1e-9
FOUND = "row long, query_id long, vec_id long, score long"


class Bucket:
    """Rows ``at`` of a block, with the columns of their unit vectors sorted when first needed."""

    def __init__(self, block: Block, at: slice):
        self.at = at
        self.vectors = block.vectors[at].astype(np.float64)
        self.lengths = np.sqrt((self.vectors**2).sum(axis=1))
        self.longest = float(self.lengths.max(initial=0))
        self._columns: tuple[np.ndarray, np.ndarray] | None = None

    def columns(self) -> tuple[np.ndarray, np.ndarray]:
        if self._columns is None:
            unit = self.vectors / np.maximum(self.lengths, 1e-300)[:, None]
            order = np.argsort(unit, axis=0, kind="stable")
            self._columns = order, np.take_along_axis(unit, order, axis=0)
        return self._columns

    def near(self, q: np.ndarray, cosine: float) -> np.ndarray:
        """Rows whose coordinates allow an angle to the unit vector ``q`` of at least that cosine.

        Seen from an axis, a vector's angle differs from the query's by at most the angle between the two.
        """
        order, values = self.columns()
        reach = np.arccos(np.clip(cosine, -1, 1)) + SLACK
        focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS]
        from_axis = np.arccos(np.clip(q[focus], -1, 1))
        low = np.cos(np.minimum(np.pi, from_axis + reach)) - SLACK
        high = np.cos(np.maximum(0, from_axis - reach)) + SLACK
        seen = np.zeros(len(self.vectors), dtype=np.int8)
        for f, a, b in zip(focus, low, high, strict=True):
            start, end = np.searchsorted(values[:, f], a, "left"), np.searchsorted(values[:, f], b, "right")
            seen[order[start:end, f]] += 1
        return np.flatnonzero(seen == len(focus))


def local_thresholds(floors: np.ndarray, lengths: np.ndarray, longest: float) -> np.ndarray:
    """Least cosine with which a row of a bucket can reach each query's floor."""
    reach = lengths * longest
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(reach > 0, floors / reach, np.where(floors > 0, np.inf, -np.inf))


def bucket_hits(queries: Block, block: Block, bucket: Bucket, floors: np.ndarray, k: int):
    """(query, rows of the block, their scores) for each query with rows that may be among its k best."""
    q = queries.vectors.astype(np.float64)
    lengths = np.sqrt((q**2).sum(axis=1))
    exact = queries.largest * block.largest * max(1, block.dim) < 2**53
    local = local_thresholds(floors, lengths, bucket.longest) if exact else np.full(len(q), -np.inf)
    by_coordinate = (local >= COORDINATE_FROM) & (local <= 1 + SLACK)
    by_length = np.flatnonzero(local < COORDINATE_FROM)
    start = bucket.at.start
    for i in np.flatnonzero(by_coordinate):
        rows = bucket.near(q[i] / lengths[i], local[i])
        scores = bucket.vectors[rows] @ q[i]
        good = scores >= floors[i]
        if good.any():
            yield i, start + rows[good], scores[good]
    if not by_length.size:
        return
    if not exact:
        scores = products(queries, block, bucket.at)
        for i in range(len(q)):
            yield i, start + np.arange(scores.shape[1]), scores[i]
        return
    # A row shorter than this reaches no floor of these queries; rows go from the longest down.
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(lengths[by_length] > 0, floors[by_length] / lengths[by_length], -np.inf).min()
    n = int(np.searchsorted(-bucket.lengths, -least * (1 - SLACK) if least > 0 else np.inf, "right"))
    scores = q[by_length] @ bucket.vectors[:n].T
    bounds = floors[by_length]
    if n > k + 1:
        bounds = np.maximum(bounds, np.partition(scores, n - k - 1, axis=1)[:, n - k - 1])
    at, rows = np.nonzero(scores >= bounds[:, None])
    cuts = np.searchsorted(at, np.arange(len(by_length) + 1))
    for j, i in enumerate(by_length):
        own = rows[cuts[j] : cuts[j + 1]]
        if own.size:
            yield i, start + own, scores[j, own]


def best_in_block(k: int):
    """Function for one block and one block of queries: the k best rows of each query there, if they reach its floor."""

    def search(blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        for b in blocks.itertuples():
            block = Block(b)
            first = block.first_ids()
            buckets = [Bucket(block, slice(at, min(at + BUCKET_ROWS, block.n))) for at in range(0, block.n, BUCKET_ROWS)]
            for row in queries.itertuples():
                asked = Block(row)
                own, numbers = asked.ids, asked.tags
                floors = np.frombuffer(row.floors, np.float64).copy()
                best: list[list[tuple[int, int]]] = [[] for _ in range(asked.n)]
                for bucket in buckets:
                    for i, rows, scores in bucket_hits(asked, block, bucket, floors, k):
                        # Of copies each has k + 1 ids, so k + 1 distinct vectors always hold the k best others.
                        order = np.lexsort((first[rows], -scores))[: k + 1]
                        found = [(-int(s), m) for r, s in zip(rows[order], scores[order], strict=True) for m in block.members(r).tolist()]
                        best[i] = sorted(best[i] + [x for x in found if x[1] != own[i]])[:k]
                        if len(best[i]) == k:
                            floors[i] = max(floors[i], float(-best[i][-1][0]))
                out += [(int(numbers[i]), int(own[i]), m, -s) for i in range(asked.n) for s, m in best[i]]
        return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"])

    return search


def query_blocks(queries: DataFrame, order: list[str], size: int) -> DataFrame:
    """Packed blocks of queries (row, query_id, vector, dim, floor), with their floors and the least length that counts."""
    own = queries.withColumns({"ids": F.array("query_id"), "tag": F.col("row")})
    placed = in_blocks(own, order, size)

    def with_floors(frame: pd.DataFrame) -> pd.DataFrame:
        from granary.llm.vectors import pack

        frame = frame.sort_values("_rank", ignore_index=True)
        floors = frame["floor"].to_numpy(np.float64)
        return pack(frame).assign(floors=[floors.tobytes()], least=[float(frame["least"].min())])

    shape = "dim long, block long, n long, ids binary, starts binary, tags binary, vectors binary, floors binary, least double"
    plain = placed.select("dim", "block", "_rank", "ids", "tag", "vector", "floor", "least")
    return plain.groupBy("dim", "block").applyInPandas(with_floors, shape)


def searched(blocks: DataFrame, asked: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """``FOUND`` rows of every pair (dim, block, query_block) of a block and a block of queries."""
    left = blocks.join(pairs, ["dim", "block"])
    right = asked.withColumnRenamed("block", "query_block").join(pairs, ["dim", "query_block"])
    key = ["dim", "block", "query_block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(best_in_block(k), FOUND)


def largest_products(
    queries: DataFrame, vectors: DataFrame, k: int = 10, factor: int = FACTOR, block_rows: int = BLOCK_ROWS, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k largest products of each query with rows of ``vectors``.

    Both tables have vec_id and embedding; a component x counts as ``floor(factor * x)``, a score is the
    integer inner product of two such vectors of one length. Ties go to the smaller vec_id; rows with the
    query's own id do not count; with fewer than k candidates all are returned. Rows with a null id, or
    a vector that is null or holds a null or non-finite component, take no part, zero vectors do.
    Repeated rows count once, also among the queries. Other columns are not read; an empty table gives none.
    """
    whole = whole_vectors(vectors, factor)
    # Of many copies of a vector only the k + 1 of the smallest ids can be returned.
    copy = F.row_number().over(Window.partitionBy("dim", "vector").orderBy("vec_id"))
    distinct = whole.withColumn("_copy", copy).where(F.col("_copy") <= k + 1).groupBy("dim", "vector")
    distinct = distinct.agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    distinct = written(distinct.withColumns({"length": length, "shorter": -length, "first": F.get("ids", F.lit(0))}), "distinct-vectors")
    placed = written(in_blocks(distinct, ["shorter", "first"], block_rows).withColumn("tag", F.lit(0)), "vectors-by-length")
    blocks = written(packed(placed), "vector-blocks")
    lengths = written(placed.groupBy("dim", "block").agg(F.max("length").alias("longest")), "block-lengths")

    asked = whole_vectors(queries, factor).withColumnRenamed("vec_id", "query_id")
    asked = asked.withColumns({"row": F.monotonically_increasing_id(), "length": length})
    nothing = F.lit(float("-inf"))
    asked = written(asked.withColumns({"floor": nothing, "least": nothing}), "queries")
    first_blocks = written(query_blocks(asked, ["query_id", "row"], query_block), "query-blocks")
    pairs = first_blocks.select("dim", F.lit(0).cast("long").alias("block"), F.col("block").alias("query_block"))
    first = written(searched(blocks.where("block = 0"), first_blocks, pairs, k), "longest-vectors")

    known = first.groupBy("row").agg(F.count("*").alias("_n"), F.min("score").alias("_score")).where(F.col("_n") == k)
    floored = asked.drop("floor", "least").join(known.select("row", "_score"), "row", "left")
    floor = F.coalesce(F.col("_score").cast("double"), nothing)
    # A little below, so that rounding leaves out no block; a floor up to 0 can be reached at any length.
    least = F.when(floor > 0, floor / F.col("length") * (1 - SLACK)).otherwise(nothing)
    later = written(query_blocks(floored.withColumns({"floor": floor, "least": least}), ["least", "row"], query_block), "query-blocks")
    last = lengths.groupBy("dim").agg(F.max("block").alias("last")).where("last > 0")
    pairs = later.select("dim", F.col("block").alias("query_block"), "least").join(last, "dim")
    pairs = pairs.select("dim", "query_block", "least", F.explode(F.sequence(F.lit(1).cast("long"), "last")).alias("block"))
    pairs = pairs.join(lengths, ["dim", "block"]).where("longest >= least").select("dim", "block", "query_block")
    rest = searched(blocks, later, written(pairs, "block-pairs"), k)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    both = first.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k)
    return both.select("query_id", "rank", "vec_id", "score")
