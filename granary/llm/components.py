"""Connected components of a table of links, by rounds that contract the graph."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.session import written

#: Steps up the tree of chosen neighbours per round, as doublings.
DOUBLINGS = 2


def lower_first(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def contracted(edges: DataFrame, number: int) -> DataFrame:
    """``node`` and ``label``, a node in reach that takes its place, for every node of ``edges``.

    A node goes to the neighbour of the least rank if that is below its own, and from there on up. Ranks
    are drawn anew for each round, so that in any graph at most half of the nodes are expected to stay.
    """
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(number)).alias("rank"), F.col(c).alias("id"))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.min(rank("b")).alias("near"))
    steps = near.select(F.col("a").alias("node"), F.least("near", rank("a"))["id"].alias("label"))
    for _ in range(DOUBLINGS):
        steps = written(steps, "steps")
        above = steps.select(F.col("node").alias("_at"), F.col("label").alias("_up"))
        steps = steps.join(above, steps["label"] == above["_at"]).select("node", F.col("_up").alias("label"))
    return written(steps, "steps")


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node in reach) for every node of ``links`` (a, b: long).

    Each round lets neighbours stand for nodes, and rewrites the links to those; loops and repeated
    links go, so that a group of copies has few links left after the first round. Tables, not driver
    memory, carry the state from round to round; the driver sees one bit per round. A node with very
    many links is summed up before the shuffle, and joins split its rows.
    """
    edges = written(links.where("a <> b").select(*lower_first(F.col("a"), F.col("b"))).distinct(), "links")
    names = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    for number in count():
        if edges.isEmpty():
            break
        steps = contracted(edges, number)
        names = names.join(steps.toDF("_node", "_label"), F.col("label") == F.col("_node"), "left")
        names = written(names.select("node", F.coalesce("_label", "label").alias("label")), "labels")
        ends = edges.join(steps.toDF("a", "_a"), "a").join(steps.toDF("b", "_b"), "b")
        edges = written(ends.where("_a <> _b").select(*lower_first(F.col("_a"), F.col("_b"))).distinct(), "links")
    least = names.groupBy("label").agg(F.min("node").alias("component"))
    return names.join(least, "label").select("node", "component")
