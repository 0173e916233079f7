"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

Documents with the same n-gram set form a copy class; one member stands for it from there on. Class
members that share a band are chained to the smallest in the bucket, so a bucket of any size gives a
row per member, not per pair; after a few bands a component stands for its members. The chained sets of candidates are cut into blocks of a fixed size;
each pair of blocks is verified by one task, which returns a count and a local component per document.
So every pair of different texts among the candidates is compared on its full sets, no pair is ever
a row, and no task holds more than two blocks.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import KEY, keyed
from granary.llm.components import connected_components
from granary.session import written

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 256
FIRST_BANDS = 4
BLOCK_DOCUMENTS = 256
BLOCK_SHINGLES = 500_000
WORDS = re.compile(r"[^ \t\n\x0b\x0c\r]+")
ODD = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows per band, hence the fewest false candidates, within ``max_hashes``.

    A pair at the threshold shares a band with probability ``1 - (1 - threshold**rows)**bands``, at
    least ``recall``.
    """
    best = None
    for rows in range(1, max_hashes + 1):
        share = threshold**rows
        bands = 1 if share >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-share))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches the recall within max_hashes")
    return best


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text; fewer words make one n-gram."""
    words = [WORDS.findall(t) for t in texts]
    flat = np.array([w for ws in words for w in ws], dtype=object)
    hashes = pd.util.hash_array(flat, categorize=True) if flat.size else np.empty(0, np.uint64)
    rolled = np.zeros(hashes.size, dtype=np.uint64)
    for k in range(n):
        rolled = rolled * ODD + (np.concatenate([hashes[k:], np.zeros(min(k, hashes.size), np.uint64)]))
    rolled = mixed(rolled)
    out, at = [], 0
    for ws in words:
        if len(ws) >= n:
            out.append(np.unique(rolled[at : at + len(ws) - n + 1]))
        elif ws:
            one = np.uint64(len(ws))
            for h in hashes[at : at + len(ws)]:
                one = np.uint64((int(one) * int(ODD) + int(h)) % (1 << 64))
            out.append(mixed(np.array([one], dtype=np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at += len(ws)
    return out


@lru_cache(maxsize=4)
def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.Generator(np.random.PCG64(17))
    factor = random.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return factor, random.integers(0, 1 << 32, count, dtype=np.uint32)


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash per band of the MinHash signature of a non-empty set."""
    factor, offset = permutations(bands * rows)
    short = (grams >> np.uint64(32)).astype(np.uint32)
    low = np.full(bands * rows, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, short.size, 256):
        low = np.minimum(low, (short[at : at + 256, None] * factor + offset).min(axis=0))
    low = low.reshape(bands, rows).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        out = mixed(out * ODD + low[:, r])
    return out.view(np.int64)


def text_blocks(frame: pd.DataFrame, chars: int = 1_000_000) -> Iterator[pd.DataFrame]:
    step = max(1, chars * len(frame) // max(1, int(frame["text"].str.len().sum())))
    for at in range(0, len(frame), step):
        yield frame.iloc[at : at + step]


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """Key columns, ``print`` (of the n-gram set; null without words), ``n_grams`` and ``bands``."""
    plain = keyed(docs.select("doc_id", "text")).select(*KEY, F.coalesce("text", F.lit("")).alias("text"))

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in text_blocks(frame):
                sets = shingle_sets(part["text"].tolist(), n)
                yield part[KEY].assign(
                    print=[hashlib.blake2b(s.tobytes(), digest_size=16).digest() if s.size else None for s in sets],
                    n_grams=[s.size for s in sets],
                    bands=[band_hashes(s, bands, rows) if s.size else [] for s in sets],
                )

    return plain.mapInPandas(
        sign, "_k_null boolean, _k_id long, _k_text long, print binary, n_grams long, bands array<long>"
    )


def verified_block(threshold: Fraction):
    """Function for one pair of blocks: per document the copies it links to there, and a local component."""

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", ignore_index=True)
        nodes, sizes = frame["node"].to_numpy(), frame["n_grams"].to_numpy()
        left = np.flatnonzero((frame["block"] == frame["low"]).to_numpy())
        right = np.flatnonzero((frame["block"] == frame["high"]).to_numpy())
        grams = np.concatenate([np.frombuffer(g, np.uint64) for g in frame["grams"]])
        owner = np.repeat(np.arange(len(frame)), sizes)
        codes, counts = np.unique(grams, return_inverse=True, return_counts=True)[1:]
        shared = counts[codes] > 1
        codes, owner = np.unique(codes[shared], return_inverse=True)[1], owner[shared]
        order = np.argsort(codes, kind="stable")
        codes, owner = codes[order], owner[order]
        both = np.zeros((left.size, right.size), dtype=np.float64)
        width = 8192
        for at in range(0, int(codes[-1]) + 1 if codes.size else 0, width):
            a, b = np.searchsorted(codes, [at, at + width])
            dense = np.zeros((len(frame), width), dtype=np.float32)
            dense[owner[a:b], codes[a:b] - at] = 1
            both += dense[left] @ dense[right].T
        both = np.rint(both).astype(np.int64)
        union = sizes[left][:, None] + sizes[right][None, :] - both
        linked = (both * threshold.denominator >= threshold.numerator * union) & (nodes[left][:, None] != nodes[right][None, :])
        copies = frame["copies"].to_numpy()
        found = np.zeros(len(frame), dtype=np.int64)
        found[left] += linked.astype(np.int64) @ copies[right]
        if frame["low"].iat[0] != frame["high"].iat[0]:
            found[right] += linked.T.astype(np.int64) @ copies[left]
        label = np.arange(len(frame))
        far = len(frame)
        while True:
            new = label.copy()
            np.minimum.at(new, left, np.where(linked, label[right][None, :], far).min(axis=1, initial=far))
            np.minimum.at(new, right, np.where(linked, label[left][:, None], far).min(axis=0, initial=far))
            new = new[new]
            if (new == label).all():
                break
            label = new
        some = found > 0
        return pd.DataFrame({"node": nodes[some], "linked": found[some], "root": nodes[label[some]]})

    return verify


def bucket_components(classes: DataFrame, bands: int) -> DataFrame:
    """``node`` and ``component`` of the members of ``classes`` (node, bands) that share a band with another one.

    The first ``FIRST_BANDS`` bands come first: a group of near copies is mostly one component by then, and
    in the other bands one row per component stands for all its members with a hash.
    """
    named = classes.select("node", "bands", F.col("node").alias("name"))
    cuts = [0, min(FIRST_BANDS, bands), bands]
    for first, last in zip(cuts, cuts[1:], strict=False):
        hashes = F.slice("bands", first + 1, last - first)
        banded = named.select("name", F.posexplode(hashes).alias("band", "hash")).distinct()
        buckets = banded.groupBy("band", "hash").agg(F.min("name").alias("low"), F.max("name").alias("high"))
        chains = banded.join(buckets.where("low < high").drop("high"), ["band", "hash"])
        found = connected_components(chains.select(F.col("name").alias("a"), F.col("low").alias("b")))
        found = found.toDF("_name", "component")
        named = named.join(found, named["name"] == found["_name"], "left").select(
            "node", "bands", F.coalesce("component", "name").alias("name")
        )
    sizes = named.groupBy("name").agg(F.count("*").alias("members")).where("members > 1").select("name")
    return named.join(sizes, "name").select("node", F.col("name").alias("component"))


def jaccard_classes(
    docs: DataFrame,
    n: int = NGRAM,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    max_hashes: int = MAX_HASHES,
    block_documents: int = BLOCK_DOCUMENTS,
) -> DataFrame:
    """One row per document: key columns, ``n_links``, and ``keep_null, keep_id, keep_text``, its class's first key.

    Words are runs without white space, compared as they are; a text of fewer than ``n`` words is one
    n-gram. Documents link where the Jaccard similarity of their n-gram sets is at least
    ``threshold``; classes are the connected documents, and their first member is the smallest by id
    (a null id comes last), then by text hash. Texts without a word, null ones too, link to none and
    are classes of their own. Repeated rows link to each other. Only doc_id and text are read; a
    table without rows gives none.
    """
    bands, rows = choose_bands(threshold, recall, max_hashes)
    signed = written(signatures(docs, n, bands, rows), "signatures")
    first = F.struct(*KEY)
    classes = written(
        signed.where("print is not null")
        .groupBy("print")
        .agg(F.count("*").alias("copies"), F.min(first).alias("first"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()),
        "copy-classes",
    )
    candidates = written(bucket_components(classes, bands), "candidates")
    known = classes.select("node", "copies", "n_grams", "first")
    members = candidates.join(known, "node")
    blocks = members.groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / block_documents), F.ceil(F.sum("n_grams") / BLOCK_SHINGLES)).alias("n_blocks")
    )
    members = members.join(blocks, "component").select(
        "node", "component", "copies", "n_blocks", F.pmod(F.xxhash64("node"), F.col("n_blocks")).alias("block"), "first.*"
    )
    texts = keyed(docs.select("doc_id", "text")).select(*KEY, "text")
    texts = texts.join(members, KEY).groupBy(*KEY, "node", "component", "copies", "n_blocks", "block").agg(F.first("text").alias("text"))

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in text_blocks(frame):
                grams = shingle_sets(part["text"].tolist(), n)
                yield part.drop(columns="text").assign(n_grams=[g.size for g in grams], grams=[g.tobytes() for g in grams])

    shape = "node long, component long, copies long, n_blocks long, block long"
    compared = (
        texts.select("node", "component", "copies", "n_blocks", "block", "text")
        .mapInPandas(sets, f"{shape}, n_grams long, grams binary")
        .withColumn("other", F.explode(F.expr("sequence(0L, n_blocks - 1)")))
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .drop("n_blocks", "other")
        .groupBy("component", "low", "high")
        .applyInPandas(verified_block(Fraction(str(threshold))), "node long, linked long, root long")
    )
    compared = written(compared, "links-by-block")
    linked = compared.groupBy("node").agg(F.sum("linked").alias("linked"))
    joined = connected_components(compared.select(F.col("node").alias("a"), F.col("root").alias("b")))
    grouped = (
        classes.select("node", "print", "copies", "first")
        .join(linked, "node", "left")
        .join(joined, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    firsts = grouped.groupBy("component").agg(F.min("first").alias("keep"))
    grouped = grouped.join(firsts, "component").select(
        F.col("print").alias("_print"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "keep"
    )
    return signed.join(grouped, signed["print"] == grouped["_print"], "left").select(
        *KEY,
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("keep._k_null"), F.col("_k_null")).alias("keep_null"),
        F.coalesce(F.col("keep._k_id"), F.col("_k_id")).alias("keep_id"),
        F.coalesce(F.col("keep._k_text"), F.col("_k_text")).alias("keep_text"),
    )


def one_per_class(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents whose class has an earlier member; of repeated rows one stays.

    Texts without a word all stay. Columns of the input pass through.
    """
    classes = jaccard_classes(docs, **options)
    later = classes.where(F.struct(*KEY) != F.struct("keep_null", "keep_id", "keep_text")).select(*KEY).distinct()
    rest = keyed(docs).join(later, KEY, "left_anti")
    again = Window.partitionBy(*KEY).orderBy(F.lit(0))
    wordless = ~F.coalesce("text", F.lit("")).rlike(WORDS.pattern)
    return rest.withColumn("_again", F.row_number().over(again)).where((F.col("_again") == 1) | wordless).drop(*KEY, "_again")
