"""Approximate nearest neighbours: a navigable small-world graph per shard, shard results merged.

Rows are dealt to shards of a fixed size by a hash of their id. A shard's graph holds its distinct
vectors and is kept as flat arrays: one of neighbours, one of where a vector's neighbours start.
Queries come in blocks; a task searches one graph for one block. The distances returned are exact.
"""

from __future__ import annotations

import math
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import shuffle_partitions
from granary.session import written

SHARD_ROWS, QUERY_BLOCK = 4096, 1024
#: Shards that one task searches for a block of queries, at most.
SHARD_GROUP = 8
#: Neighbours on the upper layers and on the ground layer; candidates while building and while searching.
LINKS, GROUND_LINKS, BUILD_WIDTH, SEARCH_WIDTH = 12, 24, 64, 128
GRAPH = (
    "shard long, dim int, entry int, ids array<long>, owners array<int>, vectors binary, "
    "levels array<int>, starts array<int>, neighbours array<int>"
)


def usable(vector: Column) -> Column:
    """Not null, not zero, and no null or non-finite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


class Graph:
    """Layers of links over the rows of ``x`` in flat arrays; layer 0 has all rows."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, starts: np.ndarray, neighbours: np.ndarray, entry: int):
        self.x, self.levels, self.starts, self.neighbours, self.entry = x, levels, starts, neighbours, entry
        self.mark = np.zeros(len(x), dtype=np.int64)
        self.round = 0

    @classmethod
    def build(cls, x: np.ndarray, seeds: np.ndarray) -> Graph:
        """Inserts the rows in order; ``seeds`` in (0, 1] draw their top layers."""
        levels = np.minimum(np.floor(-np.log(seeds) / math.log(LINKS)), 12).astype(np.int32)
        widths = GROUND_LINKS + levels * LINKS
        starts = np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)
        graph = cls(x, levels, starts, np.full(int(starts[-1]), -1, dtype=np.int32), 0)
        for i in range(1, len(x)):
            graph._insert(i)
        return graph

    def slot(self, i: int, layer: int) -> np.ndarray:
        """View of the neighbours of a row on a layer, -1 where there is none yet."""
        at = self.starts[i] + (GROUND_LINKS + (layer - 1) * LINKS if layer else 0)
        return self.neighbours[at : at + (LINKS if layer else GROUND_LINKS)]

    def distances(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        gap = self.x[rows] - q
        return np.einsum("ij,ij->i", gap, gap)

    def search_layer(self, q: np.ndarray, entries: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The ``width`` nearest rows found on a layer, nearest first."""
        self.round += 1
        mark, now = self.mark, self.round
        for _, i in entries:
            mark[i] = now
        todo = list(entries)
        heapify(todo)
        found = [(-d, i) for d, i in entries]
        heapify(found)
        while todo:
            d, i = heappop(todo)
            if len(found) >= width and d > -found[0][0]:
                break
            near = self.slot(i, layer)
            near = near[near >= 0]
            near = near[mark[near] != now]
            if not near.size:
                continue
            mark[near] = now
            gaps = self.distances(q, near)
            if len(found) >= width:
                close = gaps < -found[0][0]
                near, gaps = near[close], gaps[close]
            for g, k in zip(gaps.tolist(), near.tolist(), strict=True):
                if len(found) < width:
                    heappush(found, (-g, k))
                    heappush(todo, (g, k))
                elif g < -found[0][0]:
                    heapreplace(found, (-g, k))
                    heappush(todo, (g, k))
        return sorted((-d, i) for d, i in found)

    def descend(self, q: np.ndarray, layer: int) -> list[tuple[float, int]]:
        """Entry for a layer: the nearest row by greedy steps on the layers above it."""
        at = [(float(self.distances(q, np.array([self.entry]))[0]), self.entry)]
        for high in range(int(self.levels[self.entry]), layer, -1):
            at = self.search_layer(q, at, 1, high)
        return at

    def chosen(self, rows: np.ndarray, gaps: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of ``rows`` (nearest first): those nearer to the row than to a chosen one, then the nearest others."""
        if rows.size <= most:
            return rows
        x = self.x[rows]
        square = np.einsum("ij,ij->i", x, x)
        between = square[:, None] + square[None, :] - 2 * (x @ x.T)
        least = np.full(rows.size, np.inf)
        taken: list[int] = []
        for i in range(rows.size):
            if gaps[i] < least[i]:
                taken.append(i)
                if len(taken) == most:
                    break
                np.minimum(least, between[i], out=least)
        if len(taken) < most:
            rest = np.setdiff1d(np.arange(rows.size), taken)
            taken += rest[: most - len(taken)].tolist()
        return rows[taken]

    def _insert(self, i: int) -> None:
        q, top = self.x[i], int(self.levels[self.entry])
        own = int(self.levels[i])
        entries = self.descend(q, min(own, top))
        for layer in range(min(own, top), -1, -1):
            entries = self.search_layer(q, entries, BUILD_WIDTH, layer)
            rows = np.array([k for _, k in entries], dtype=np.int64)
            gaps = np.array([d for d, _ in entries])
            links = self.chosen(rows, gaps, LINKS)
            self.slot(i, layer)[: links.size] = links
            for k in links.tolist():
                slot = self.slot(k, layer)
                free = np.flatnonzero(slot < 0)
                if free.size:
                    slot[free[0]] = i
                    continue
                rows = np.append(slot, i).astype(np.int64)
                gaps = self.distances(self.x[k], rows)
                order = np.argsort(gaps, kind="stable")
                keep = self.chosen(rows[order], gaps[order], slot.size)
                slot[:] = -1
                slot[: keep.size] = keep
        if own > top:
            self.entry = i

    def search(self, q: np.ndarray, width: int) -> list[tuple[float, int]]:
        return self.search_layer(q, self.descend(q, 0), width, 0)


def drawn(ids: np.ndarray) -> np.ndarray:
    """A number in (0, 1] per id, the same in every run."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return ((h >> np.uint64(11)).astype(np.float64) + 1) / float(1 << 53)


def build_shard(frame: pd.DataFrame) -> pd.DataFrame:
    """One row: the graph of a shard. Equal vectors are one row of the graph with several ids."""
    frame = frame.sort_values("vec_id", kind="stable", ignore_index=True)
    x = np.stack(frame["vector"]).astype(np.float64)
    ids = frame["vec_id"].to_numpy(np.int64)
    distinct, first, owner = np.unique(x, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")  # by smallest id instead of by value
    place = np.empty(order.size, dtype=np.int64)
    place[order] = np.arange(order.size)
    x, owner = distinct[order], place[owner.ravel()]
    graph = Graph.build(x, drawn(ids[first[order]]))
    return pd.DataFrame(
        {
            "shard": [int(frame["shard"].iat[0])],
            "dim": [x.shape[1]],
            "entry": [graph.entry],
            "ids": [ids],
            "owners": [owner.astype(np.int32)],
            "vectors": [x.tobytes()],
            "levels": [graph.levels],
            "starts": [graph.starts.astype(np.int32)],
            "neighbours": [graph.neighbours],
        }
    )


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Graphs of all usable rows of ``vectors`` (vec_id, embedding), one row per shard, as a written table.

    Rows with a null id, or a vector that is null, zero, or holds a null or non-finite component, take
    no part. Repeated rows count once. Vectors of different lengths get shards of their own. Other
    columns are not read; a table without rows gives none.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).dropDuplicates(["vec_id", "vector"])
    n = vectors.count()
    shards = max(1, math.ceil(n / shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    # By number: Spark would take a few thousand vectors for little work and give them to one task.
    # By range: hashing a few shard numbers would let several meet in one task.
    dealt = dealt.repartitionByRange(min(shards, 8 * shuffle_partitions(vectors.sparkSession)), "shard")
    graphs = dealt.groupBy("shard", F.size("vector").alias("dim")).applyInPandas(build_shard, GRAPH)
    return written(graphs, "small-worlds")


def search_block(k: int, width: int):
    """Function for the graphs of a group and one block of queries: the k nearest of each query in them."""

    def search(graphs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: dict[int, tuple[int, list[tuple[float, int]]]] = {}
        for g in graphs.itertuples():
            x = np.frombuffer(g.vectors, np.float64).reshape(-1, g.dim)
            graph = Graph(x, np.asarray(g.levels), np.asarray(g.starts), np.asarray(g.neighbours), g.entry)
            ids, owners = np.asarray(g.ids), np.asarray(g.owners)
            by_owner = np.argsort(owners, kind="stable")  # ids of a vector stay in ascending order
            starts = np.searchsorted(owners[by_owner], np.arange(len(x) + 1))
            for q in queries.itertuples():
                if q.dim != g.dim:
                    continue
                own, vector = q.query_id, np.asarray(q.vector, dtype=np.float64)
                near: list[tuple[float, int]] = []
                # Copies of a vector share its distance: k + 1 of them always hold k others.
                for _, i in graph.search(vector, max(width, k + 1)):
                    gap = x[i] - vector
                    members = ids[by_owner[starts[i] : starts[i + 1]][: k + 1]]
                    near += [(float(np.sqrt((gap * gap).sum())), m) for m in members.tolist() if m != own]
                before = found.get(q.row, (own, []))[1]
                found[q.row] = own, sorted(before + near)[:k]
        flat = [(row, own, m, d) for row, (own, near) in found.items() for d, m in near]
        return pd.DataFrame(flat, columns=["row", "query_id", "vec_id", "score"])

    return search


def nearest(
    queries: DataFrame, index: DataFrame, k: int = 10, width: int = SEARCH_WIDTH, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest rows found for each query, ties to smaller vec_id.

    ``queries`` has vec_id and embedding like the index; unusable ones give no row, repeated ones count
    once. A query's own id is never its neighbour. With fewer than k candidates all are returned.
    """
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("vector"))
    asked = asked.where(F.col("query_id").isNotNull() & usable(F.col("vector"))).dropDuplicates(["query_id", "vector"])
    asked = written(asked.withColumns({"row": F.monotonically_increasing_id(), "dim": F.size("vector")}), "queries")
    blocks = max(1, math.ceil(asked.count() / query_block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    shards = index.agg(F.max("shard")).first()[0]
    # A block of queries goes once to each group of shards; groups are smaller where there would be few of them.
    pairs = blocks * (0 if shards is None else shards + 1)
    size = max(1, min(SHARD_GROUP, pairs // (2 * shuffle_partitions(queries.sparkSession))))
    last = -1 if shards is None else shards // size
    asked = asked.withColumn("group", F.explode(F.expr(f"filter(sequence(0L, {max(last, 0)}L), g -> g <= {last})")))
    graphs = index.withColumns(
        {"block": F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")), "group": F.expr(f"shard div {size}")}
    )
    found = (
        graphs.groupBy("group", "block")
        .cogroup(asked.groupBy("group", "block"))
        .applyInPandas(search_block(k, width), "row long, query_id long, vec_id long, score double")
    )
    rank = F.row_number().over(Window.partitionBy("row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
