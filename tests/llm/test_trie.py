"""Prefix trie: against a trie of Python dictionaries; the queue against a sorted list."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest

from granary.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    own: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        convs[c] = own.get(base, [])[:h] + turns[h:]
    members: dict[tuple, list[int]] = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members.setdefault(tuple(convs[c][:d]), []).append(c)
    children: dict[tuple, int] = {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, own_members in members.items():
        words = len(node[-1][1].split()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(own_members) - 1) * words
    out = []
    for node, inside in members.items():
        ends = ",".join(str(c) for c in inside if len(convs[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append((inside[0], len(node), parent, len(inside), children.get(node, 0), leaves[node], saved[node], sha256(ends.encode()).hexdigest()))
    return sorted(out)


def built(spark, rows, **options):
    steps, lengths = trie.rebuilt(trie.fingerprinted(spark.createDataFrame(rows, SCHEMA)))
    return sorted(tuple(r[n] for n in NAMES) for r in trie.prefix_trie(steps, lengths, **options).collect())


def conversations(seed, n=160):
    """Few distinct turns, so that prefixes meet; ids below zero, missing bases, a deep one, a very common one."""
    random.seed(seed)
    rows = []
    for c in random.sample(range(-60, 300), n):
        turns = [(random.choice("ab"), " ".join(random.choice("xyz") for _ in range(random.choice([0, 1, 2])))) for _ in range(random.randrange(1, 7))]
        if c % 3 == 0:
            turns = [("user", "hello there"), ("assistant", "how are you")] + turns[:1]
        rows += [(c, None if i == 0 and c % 7 == 0 else i, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(1000, i, "a", f"deep {i % 5}") for i in range(60)] + [(1001, i, "a", f"deep {i % 5}") for i in range(45)]
    return rows


@pytest.mark.parametrize("shard", [1, 7, 4096])
def test_trie_against_dictionaries(spark, monkeypatch, shard):
    """Few members per shard: many heavy chains and shard roots; tiny queues, parts and pieces."""
    monkeypatch.setattr(trie, "PART_TURNS", 8)
    monkeypatch.setattr(trie, "PIECE_IDS", 16)
    rows = conversations(shard)
    assert built(spark, rows, shard_conversations=shard, queue_entries=3) == plain_trie(rows)


def test_trie_odd_rows(spark):
    rows = [
        (None, 0, "user", "left out"), (5, None, None, None), (5, 1, "user", "a"), (5, 1, "user", "a"), (7, 0, "user", ""),
        (9, 3, None, "w " * 50_000), (2**60 + 1, 0, "user", "a"), (2**60 + 2, 0, "user", "a"), (21, 0, "", ""), (41, 0, None, None),
    ]
    assert built(spark, rows) == plain_trie(rows)
    assert built(spark, []) == []


def test_trie_reads_its_columns_only(spark):
    from pyspark.sql import functions as F

    rows = conversations(3, 30)
    df = spark.createDataFrame(rows, SCHEMA)
    extra = ["depth", "length", "a", "b", "pos", "words", "part", "heavy", "top", "n_convs", "own"]
    df = df.select("*", *[F.lit("x").alias(c) for c in extra])
    steps, lengths = trie.rebuilt(trie.fingerprinted(df))
    assert sorted(tuple(r[n] for n in NAMES) for r in trie.prefix_trie(steps, lengths).collect()) == plain_trie(rows)


@pytest.mark.parametrize("most", [2, 50, 10_000])
def test_queue_gives_the_least_first(most, monkeypatch):
    monkeypatch.setattr(trie, "RUN_ENTRIES", 7)
    random.seed(most)
    queue, held = trie.SpillingQueue(most), []
    for _ in range(4000):
        if held and random.random() < 0.4:
            assert queue.least() == min(held)
            held.remove(got := queue.pop())
            assert got <= min(held, default=got)
        else:
            entry = (random.randrange(50), random.randrange(10**6), random.random())
            queue.push(entry)
            held.append(entry)
    assert [queue.pop() for _ in held] == sorted(held) and queue.least() is None
    assert bool(queue.spilled) == (most < 4000)


def test_a_lost_parent_is_an_error():
    import pyarrow as pa

    one = pa.RecordBatch.from_pylist([dict(conv=1, n=1, bottom=3, up_conv=0, up_n=2, up_bottom=2, inside=True, c=0, leaves=0, s=0)])
    with pytest.raises(RuntimeError, match="no chain took"):
        list(trie.passed_up()(iter([one])))
