"""Hard negatives per anchor and positive: the best scores in overlapping windows, from disjoint slots.

A window of an anchor takes the scores from a share of a positive's score up to a larger share of it.
The upper limits of the anchor's positives, sorted down, cut the scores into disjoint slots; a window
holds a suffix of them, down to its own lower limit. So k entries per slot are enough: tasks keep
those of the rows that they see, and a merge of each slot into the next higher one, from the lowest
up, answers all windows at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.vectors import Block, in_blocks, packed, products, whole_vectors
from granary.session import written

FACTOR = 256
BLOCK_ROWS, ANCHOR_BLOCK, STEP_ROWS = 8192, 1024, 2048
POSITIVES, NEGATIVES = 5, 3
#: Percent of the positive's score: least and most of a negative's.
LOWEST, HIGHEST = 50, 95


def best_same_label(most: int):
    """Function for a block of rows and one of anchors: each anchor's best rows of its own label there."""

    def search(blocks: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        for b in blocks.itertuples():
            block = Block(b)
            for a in anchors.itertuples():
                asked = Block(a)
                best: list[list[tuple[int, int]]] = [[] for _ in range(asked.n)]
                for at in range(0, block.n, STEP_ROWS):
                    rows = slice(at, min(at + STEP_ROWS, block.n))
                    ids, labels = block.ids[rows], block.tags[rows]
                    scores = products(asked, block, rows)
                    for i in range(asked.n):
                        own = np.flatnonzero((labels == asked.tags[i]) & (ids != asked.ids[i]))
                        if own.size:
                            order = own[np.lexsort((ids[own], -scores[i, own]))[:most]]
                            new = [(-int(s), m) for s, m in zip(scores[i, order], ids[order].tolist(), strict=True)]
                            best[i] = sorted(best[i] + new)[:most]
                out += [(int(asked.ids[i]), m, -s) for i in range(asked.n) for s, m in best[i]]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"])

    return search


def limits(positive: int, lowest: int, highest: int) -> tuple[int, int]:
    """Least and largest whole score within the two percentages of a positive's score."""
    return -((-lowest * positive) // 100), (highest * positive) // 100


def best_per_slot(most: int, lowest: int, highest: int):
    """Function for a block of rows and one of anchors: per anchor and slot the best rows of other labels there.

    Slot j (from 1) holds the scores up to the j-th largest upper limit and above the next one.
    """

    def search(blocks: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        for b in blocks.itertuples():
            block = Block(b)
            for a in anchors.itertuples():
                asked = Block(a)
                windows = [[limits(p, lowest, highest) for p in own] for own in a.positives]
                slots: list[dict[int, list[tuple[int, int]]]] = [{} for _ in range(asked.n)]
                for at in range(0, block.n, STEP_ROWS):
                    rows = slice(at, min(at + STEP_ROWS, block.n))
                    ids, labels = block.ids[rows], block.tags[rows]
                    scores = products(asked, block, rows)
                    for i, own in enumerate(windows):
                        near = (scores[i] <= own[0][1]) & (scores[i] >= min(w[0] for w in own)) & (labels != asked.tags[i])
                        found = np.flatnonzero(near.astype(bool))
                        if not found.size:
                            continue
                        found = found[np.lexsort((ids[found], -scores[i, found]))]
                        # Scores go down, so slots go up along them: the first ones of each are its best.
                        kept = scores[i, found]
                        starts = [int(np.searchsorted(-kept, -w[1], "left")) for w in own] + [found.size]
                        for slot, (start, end) in enumerate(zip(starts, starts[1:], strict=False), 1):
                            new = [(-int(scores[i, r]), int(ids[r])) for r in found[start : min(end, start + most)]]
                            if new:
                                slots[i][slot] = sorted(slots[i].get(slot, []) + new)[:most]
                out += [(int(asked.ids[i]), slot, m, -s) for i in range(asked.n) for slot, best in slots[i].items() for s, m in best]
        return pd.DataFrame(out, columns=["anchor_id", "slot", "negative_id", "negative_score"])

    return search


def paired(blocks: DataFrame, anchors: DataFrame, pairs: DataFrame, search, shape: str) -> DataFrame:
    """``search`` over every pair (dim, block, anchor_block) of a block of rows and one of anchors."""
    key = ["dim", "block", "anchor_block"]
    left = blocks.join(pairs, ["dim", "block"]).groupBy(*key)
    right = anchors.withColumnRenamed("block", "anchor_block").join(pairs, ["dim", "anchor_block"]).groupBy(*key)
    return left.cogroup(right).applyInPandas(search, shape)


def hard_negatives(
    anchors: DataFrame,
    vectors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    lowest: int = LOWEST,
    highest: int = HIGHEST,
    factor: int = FACTOR,
    block_rows: int = BLOCK_ROWS,
    anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Both tables have vec_id, label and embedding, and every anchor is also a row of ``vectors``. A component x
    counts as ``floor(factor * x)``; a score is the integer inner product with the anchor; higher ones come
    first, ties by smaller vec_id. An anchor's positives are its first rows of the same label with another
    id, all if fewer; for each, the first rows of other labels whose score lies between ``lowest`` and
    ``highest`` percent of the positive's, both included. Rows with a null id or label, or a vector that is
    null or holds a null or non-finite component, take no part; repeated rows count once, and one id has one
    row. Anchors without a positive, and positives without a negative, give no row. Other columns are not
    read; an empty table gives none.
    """
    own = lambda df: whole_vectors(df.where("label is not null"), factor, "label")
    tagged = lambda df: df.withColumns({"ids": F.array("vec_id"), "tag": F.col("label")})
    placed = written(in_blocks(tagged(own(vectors)), ["label", "vec_id"], block_rows), "rows-by-label")
    blocks = written(packed(placed), "row-blocks")
    asked = written(in_blocks(tagged(own(anchors)), ["label", "vec_id"], anchor_block), "anchors-by-label")
    same = placed.select("dim", "block", "label").distinct().join(
        asked.select("dim", F.col("block").alias("anchor_block"), "label").distinct(), ["dim", "label"]
    )
    same = written(same.select("dim", "block", "anchor_block").distinct(), "same-label-blocks")
    found = paired(
        blocks, written(packed(asked), "anchor-blocks"), same, best_same_label(positives),
        "anchor_id long, positive_id long, positive_score long",
    )
    order = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    found = found.withColumn("place", order).where(F.col("place") <= positives)
    chosen = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("chosen"))
    chosen = written(chosen, "positives")

    # Anchors again, those with positives only, with the scores that cut their slots.
    cut = asked.drop("block", "_rank").join(chosen.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    cut = in_blocks(cut.withColumn("positives", F.col("chosen.positive_score")), ["vec_id"], anchor_block)

    def with_positives(frame: pd.DataFrame) -> pd.DataFrame:
        from granary.llm.vectors import pack

        frame = frame.sort_values("_rank", ignore_index=True)
        return pack(frame).assign(positives=[[list(map(int, p)) for p in frame["positives"]]])

    shape = "dim long, block long, n long, ids binary, starts binary, tags binary, vectors binary, positives array<array<long>>"
    plain = cut.select("dim", "block", "_rank", "ids", F.col("tag").cast("long").alias("tag"), "vector", "positives")
    cut = written(plain.groupBy("dim", "block").applyInPandas(with_positives, shape), "anchor-blocks")
    last = placed.groupBy("dim").agg(F.max("block").alias("last"))
    pairs = cut.select("dim", F.col("block").alias("anchor_block")).join(last, "dim")
    pairs = pairs.select("dim", "anchor_block", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block"))
    kept = paired(
        blocks, cut, written(pairs, "block-pairs"), best_per_slot(negatives, lowest, highest),
        "anchor_id long, slot int, negative_id long, negative_score long",
    )
    first = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("negative_score"), "negative_id"))
    kept = kept.withColumn("place", first).where(F.col("place") <= negatives)
    entry = F.struct((-F.col("negative_score")).alias("down"), "negative_id")
    slots = kept.groupBy("anchor_id", "slot").agg(F.sort_array(F.collect_list(entry)).alias("best"))
    slots = slots.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "best"))).alias("slots"))
    return windows_of_slots(chosen.join(slots, "anchor_id"), negatives, lowest)


def windows_of_slots(anchors: DataFrame, negatives: int, lowest: int) -> DataFrame:
    """Answers from ``chosen`` positives and ``slots`` per anchor: suffixes of slots, merged from the lowest up."""
    none = F.expr("cast(array() as array<array<struct<down: bigint, negative_id: bigint>>>)")
    nothing = F.expr("cast(array() as array<struct<down: bigint, negative_id: bigint>>)")
    slot = lambda i: F.coalesce(F.element_at("slots", i), nothing)

    def merged(below, i):
        best = F.slice(F.concat(slot(i), F.coalesce(F.get(below, F.lit(0)), nothing)), 1, negatives)
        return F.concat(F.array(best), below)

    up = F.reverse(F.sequence(F.lit(1), F.size("chosen")))
    suffixes = anchors.select("anchor_id", "chosen", F.aggregate(up, none, merged).alias("suffixes"))
    each = suffixes.select("anchor_id", F.explode(F.arrays_zip("chosen", "suffixes")).alias("own"))
    positive = F.col("own.chosen.positive_score")
    rows = each.select(
        "anchor_id",
        F.col("own.chosen.positive_id").alias("positive_id"),
        positive.alias("positive_score"),
        F.posexplode(F.filter("own.suffixes", lambda e: -e["down"] * 100 >= positive * lowest)).alias("at", "negative"),
    )
    return rows.select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("negative.negative_id").alias("negative_id"),
        "positive_score", (-F.col("negative.down")).alias("negative_score"),
    )
