"""Prefix trie of conversations, with totals of every subtree by time-forward processing.

A node is a sequence of turns that some conversation begins with; it is known by two 64-bit
fingerprints, running exclusive ors of the hashes of its turns with their places, so that no text
moves. Nodes with the same members in a row form a chain. The trie of chains has at most two chains
per conversation, whatever their lengths.

Chains are processed from the deepest level up. Each sends its subtree's totals to its parent,
forward in that order, through a priority queue that spills; a parent finds all of its children's
totals at the head of the queue. A chain with few members has its whole subtree in one shard, beside
other subtrees. What the roots of shards send goes to the chains above, of which each has more members than
a shard may have, so that they are few, and these are processed in the same way.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import running_start, shuffle_partitions, word_count
from granary.plans.ranks import add_rank
from granary.plans.small import small_side
from granary.session import written

FAMILY, HEADS = 20, 4
#: Conversations below a chain from which on it belongs to no shard.
SHARD_CONVERSATIONS = 4096
#: Entries that a queue holds in memory, and entries per read of a spilled run.
QUEUE_ENTRIES, RUN_ENTRIES = 200_000, 1000
#: Turns of one conversation, and ids of one node, per piece of work.
PART_TURNS, PIECE_IDS = 4096, 4096
NODE, CHAIN = ["depth", "a", "b"], ["conv_id", "n_convs"]
TOTALS = "conv_id long, n_convs long, n_children long, n_leaves long, saved long, up_conv long, up_n long"


class SpillingQueue:
    """Tuples, least first. Beyond ``most`` in memory the larger half becomes a sorted run in a scratch file.

    The file has no name, lies where Spark's own sorts spill, and is gone with the task.
    """

    def __init__(self, most: int = QUEUE_ENTRIES):
        self.most = most
        self.heap: list[tuple] = []
        self.runs: list[tuple[tuple, int, Iterator[tuple]]] = []
        self.spilled = 0

    def push(self, entry: tuple) -> None:
        heappush(self.heap, entry)
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        self.heap.sort()  # a sorted list is a heap
        half = len(self.heap) // 2
        run = self._stored(self.heap[half:])
        next(run)
        del self.heap[half:]
        self.spilled += 1
        heappush(self.runs, (next(run), self.spilled, run))

    @staticmethod
    def _stored(entries: list[tuple]) -> Iterator[tuple]:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        with tempfile.TemporaryFile(dir=folder) as file:
            for at in range(0, len(entries), RUN_ENTRIES):
                pickle.dump(entries[at : at + RUN_ENTRIES], file, pickle.HIGHEST_PROTOCOL)
            blocks = -(-len(entries) // RUN_ENTRIES)
            del entries
            file.seek(0)
            yield ()  # written; what follows is read
            for _ in range(blocks):
                yield from pickle.load(file)

    def least(self) -> tuple | None:
        heads = self.heap[:1] + [run[0] for run in self.runs[:1]]
        return min(heads, default=None)

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            head, number, run = self.runs[0]
            following = next(run, None)
            if following is None:
                heappop(self.runs)
            else:
                heapreplace(self.runs, (following, number, run))
            return head
        return heappop(self.heap)


def passed_up(entries: int = QUEUE_ENTRIES):
    """Function over chains in reverse level order, each subtree whole or its root's parent elsewhere.

    Rows are (conv_id, n_convs, bottom, up_conv, up_n, up_bottom, inside, n_children, n_leaves, saved), the
    last three without the children that are in the same partition. Gives ``TOTALS``; what goes to a parent
    elsewhere has that parent's name.
    """

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(entries)
        kinds = [pa.int64()] * 7
        names = [x.split()[0] for x in TOTALS.split(", ")]
        for batch in batches:
            out = []
            rows = zip(*[c.to_pylist() for c in batch.columns], strict=True)
            for conv, n, bottom, up_conv, up_n, up_bottom, inside, children, leaves, saved in rows:
                place = (-bottom, conv, n)
                while (head := queue.least()) is not None and head[:3] <= place:
                    if head[:3] < place:
                        raise RuntimeError(f"no chain took the totals sent to {head[:3]}")
                    _, _, _, more_leaves, more_saved = queue.pop()
                    children, leaves, saved = children + 1, leaves + more_leaves, saved + more_saved
                leaves = leaves if children else 1
                if inside:
                    queue.push((-up_bottom, up_conv, up_n, leaves, saved))
                    up_conv = up_n = None
                out.append((conv, n, children, leaves, saved, up_conv, up_n))
            columns = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
        if queue.least() is not None:
            raise RuntimeError(f"no chain took the totals sent to {queue.least()[:3]}")

    return process


def in_reverse_levels(chains: DataFrame) -> DataFrame:
    columns = ["conv_id", "n_convs", "bottom", "up_conv", "up_n", "up_bottom", "inside", "n_children", "n_leaves", "saved"]
    return chains.sortWithinPartitions(F.desc("bottom"), "conv_id", "n_convs").select(*columns)


def fingerprinted(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, two hashes ``a`` and ``b`` of role and text, and the ``words`` of the text.

    A null role or text counts as empty; rows with a null conv_id are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), role, text).alias("b"),
        word_count(F.col("text")).alias("words"),
    )


def rebuilt(said: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, length, depth, a, b, words) of the rebuilt conversations, and (conv_id, length) of all of them.

    ``said`` is what ``fingerprinted`` gives. Turns are ordered by turn, null first, equal ones by the hashes
    of role and text; repeated rows are turns of their own. Conversation c becomes the first h turns of
    conversation ``c - c % family``, all if it has fewer and none if there is no such one, and its own turns
    after its first h, where h is the crc32 of the decimal c modulo ``heads``.
    """
    ranked = add_rank(said, ["conv_id"], ["conv_id", "turn", "a", "b"], "pos")
    placed = written(ranked.select("conv_id", F.col("pos").cast("long").alias("pos"), "a", "b", "words"), "placed-turns")
    turn = F.struct("pos", "a", "b", "words")
    bases = placed.where((F.col("conv_id") % family == 0) & (F.col("pos") < heads))
    bases = bases.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("head")).toDF("base", "head")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = placed.groupBy("conv_id").agg(F.max("pos").alias("own")).withColumns(
        {"taken": taken, "base": F.col("conv_id") - F.col("conv_id") % family}
    )
    none = F.expr("cast(array() as array<struct<pos: bigint, a: bigint, b: bigint, words: bigint>>)")
    head = F.slice(F.coalesce("head", none), F.lit(1), F.col("taken").cast("int"))
    convs = convs.join(bases, "base", "left").select("conv_id", "own", "taken", head.alias("head"))
    kept = F.size("head").cast("long")
    length = kept + F.greatest(F.col("own") - F.col("taken"), F.lit(0))
    convs = written(convs.withColumns({"length": length, "shift": kept - F.col("taken")}), "rebuilt-conversations")
    borrowed = convs.select("conv_id", "length", F.explode("head").alias("t")).select(
        "conv_id", "length", F.col("t.pos").alias("depth"), "t.a", "t.b", "t.words"
    )
    own = placed.join(convs.select("conv_id", "length", "taken", "shift"), "conv_id").where(F.col("pos") > F.col("taken"))
    own = own.select("conv_id", "length", (F.col("pos") + F.col("shift")).alias("depth"), "a", "b", "words")
    return borrowed.unionByName(own), convs.select("conv_id", "length")


def with_prefixes(steps: DataFrame) -> DataFrame:
    """Every turn's node (depth, a, b), and the node above it (up_a, up_b)."""
    salted = lambda salt: F.xxhash64(F.lit(salt), "a", "b", "depth")
    part = F.expr(f"(depth - 1) div {PART_TURNS}")
    rows = steps.select("conv_id", "length", "depth", "words", salted(1).alias("own_a"), salted(2).alias("own_b"), part.alias("part"))
    rows = written(rows, "rebuilt-turns")
    inside = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "part").agg(F.bit_xor("own_a").alias("x"), F.bit_xor("own_b").alias("y"))
    ahead = lambda c: F.coalesce(F.bit_xor(c).over(across), F.lit(0).cast("long"))
    totals = totals.select("conv_id", "part", ahead("x").alias("x"), ahead("y").alias("y"))
    inner = rows.withColumns({"i": F.bit_xor("own_a").over(inside), "j": F.bit_xor("own_b").over(inside)})
    keys = inner.join(totals, ["conv_id", "part"]).withColumns(
        {"a": F.col("x").bitwiseXOR(F.col("i")), "b": F.col("y").bitwiseXOR(F.col("j"))}
    )
    return keys.select(
        "conv_id", "length", *NODE, "words",
        F.col("a").bitwiseXOR(F.col("own_a")).alias("up_a"), F.col("b").bitwiseXOR(F.col("own_b")).alias("up_b"),
    )


def subtree_totals(chains: DataFrame, entries: int = QUEUE_ENTRIES) -> DataFrame:
    """Totals of every chain's subtree; ``chains`` have ``heavy``, ``up_heavy`` and, unless heavy, their ``shard``."""
    zero = {"n_children": F.lit(0).cast("long"), "n_leaves": F.lit(0).cast("long"), "saved": F.col("own")}
    light = chains.where("not heavy").withColumns({**zero, "inside": F.col("up_conv").isNotNull() & ~F.col("up_heavy")})
    dealt = light.repartition(shuffle_partitions(chains.sparkSession), "shard")
    below = written(in_reverse_levels(dealt).mapInArrow(passed_up(entries), TOTALS), "shard-totals")
    sent = below.where("up_conv is not null").groupBy("up_conv", "up_n").agg(
        F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("sent")
    )
    heavy = chains.where("heavy").withColumn("inside", F.col("up_conv").isNotNull())
    sent = sent.withColumnsRenamed({"up_conv": "conv_id", "up_n": "n_convs"})
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("n_children", "n_leaves")}
    heavy = heavy.join(sent, CHAIN, "left").withColumns({**filled, "saved": F.col("own") + F.coalesce("sent", F.lit(0))})
    top = in_reverse_levels(heavy.repartition(1)).mapInArrow(passed_up(entries), TOTALS)
    return below.unionByName(top).select(*CHAIN, "n_children", "n_leaves", "saved")


def end_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node, ascending, comma-joined; pieces of bounded size are streamed through it."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy(*NODE, F.expr(f"conv_id div {PIECE_IDS}").alias("piece")).agg(ids.alias("ids"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        node, state, out = None, None, []
        done = lambda: pa.RecordBatch.from_pylist(
            out, pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
        )
        for batch in batches:
            for depth, a, b, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (depth, a, b) == node:
                    state.update(b"," + text.encode())
                    continue
                if node is not None:
                    out.append(dict(zip([*NODE, "ends_sha256"], [*node, state.hexdigest()], strict=True)))
                node, state = (depth, a, b), sha256(text.encode())
            yield done()
            out.clear()
        if node is not None:
            out.append(dict(zip([*NODE, "ends_sha256"], [*node, state.hexdigest()], strict=True)))
            yield done()

    ordered = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids")
    return ordered.mapInArrow(hashes, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(
    steps: DataFrame, lengths: DataFrame, shard_conversations: int = SHARD_CONVERSATIONS, queue_entries: int = QUEUE_ENTRIES
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``steps`` has a row per conversation and turn (conv_id, length, depth from 1, hashes a and b of the turn,
    words), ``lengths`` a row per conversation (conv_id, length), turnless ones included. A node is named by
    its smallest member and its depth; the root has depth 0. ``n_leaves`` counts the childless nodes of a
    subtree, its top included; ``saved_tokens`` sums (members - 1) x words of the last turn over it;
    ``ends_sha256`` covers the members that end at the node. Equal sequences are told by 128 bits of hashes.
    Without conversations there is no node.
    """
    rows = written(with_prefixes(steps), "prefixes")
    zero = F.lit(0).cast("long")
    roots = lengths.select(
        "conv_id", "length", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("words"),
        F.lit(None).cast("long").alias("up_a"), F.lit(None).cast("long").alias("up_b"),
    )
    every = rows.unionByName(roots)
    nodes = every.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.first("words").alias("words"), F.first("up_a").alias("up_a"), F.first("up_b").alias("up_b"),
    )
    nodes = nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("words"))
    nodes = written(nodes.withColumn("part", F.expr(f"depth div {PART_TURNS}")), "nodes")

    # Members only leave on the way down: equal first member and equal count mean equal members.
    chains = nodes.groupBy(*CHAIN).agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum("own").alias("own"),
        F.min_by(F.struct("up_a", "up_b"), "depth").alias("up"),
    )
    ups = nodes.select(
        F.col("depth").alias("up_bottom"), F.col("a").alias("_a"), F.col("b").alias("_b"),
        F.col("conv_id").alias("up_conv"), F.col("n_convs").alias("up_n"),
    )
    same = (F.col("up_bottom") == F.col("top") - 1) & (F.col("_a") == F.col("up.up_a")) & (F.col("_b") == F.col("up.up_b"))
    chains = chains.join(ups, same, "left").drop("_a", "_b", "up").withColumns(
        {"heavy": F.col("n_convs") > shard_conversations, "up_heavy": F.col("up_n") > shard_conversations}
    )
    heavy = nodes.where(F.col("n_convs") > shard_conversations).select(*NODE)
    # A conversation's shard is named by the first node on its path that is not heavy.
    cuts = every.join(small_side(heavy), NODE, "left_semi").groupBy("conv_id").agg(F.max("depth").alias("_cut"))
    shards = every.join(cuts, "conv_id", "left").where(F.col("depth") == F.coalesce(F.col("_cut") + 1, zero))
    shards = shards.select(F.col("conv_id").alias("_conv"), F.struct(*NODE).alias("shard"))
    chains = chains.join(shards, ~F.col("heavy") & (F.col("conv_id") == F.col("_conv")), "left").drop("_conv")
    chains = written(chains, "chains")
    totals = chains.select(*CHAIN, "top", "bottom", "up_conv").join(subtree_totals(chains, queue_entries), CHAIN)

    ends = every.where("depth = length").select(*NODE, "conv_id")
    placed = running_start(nodes, CHAIN, "part", ["depth"], "own", "_above")
    told = placed.join(totals, CHAIN).join(end_hashes(ends), NODE, "left")
    inner = F.col("depth") < F.col("bottom")
    return told.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("up_conv")).alias("parent_conv_id"),
        "n_convs",
        F.when(inner, F.lit(1).cast("long")).otherwise(F.col("n_children")).alias("n_children"),
        "n_leaves",
        (F.col("saved") - F.col("_above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
