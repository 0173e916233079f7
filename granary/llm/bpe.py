"""Byte-level BPE on padded numpy matrices, and the way back.

Texts are cut by the vocabulary's pattern. The distinct pieces of a block are encoded together: put
into matrices by length, every row merges its leftmost pair of least rank each round, pairs are found
in a hash table, and rows that are done leave the matrix. Blocks have a fixed number of pieces, so the
memory of a task does not depend on the length of a text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import tokenizer_path

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pattern that goes with the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_PIECES = 150_000
BLOCK_CHARS = 1_000_000
NONE = np.int64(1) << 40
#: Rows beyond this width are merged one by one with a heap, by the same rule.
MATRIX_WIDTH = 512


class Ranks:
    """Tokens by id, and a hash table from a pair of ids to the id of their union."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = i
        self.pairs = pairs
        self.bits = max(4, (4 * len(pairs) + 1).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, dtype=np.int64), np.full(size, NONE, dtype=np.int64)
        keys = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        values = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))
        slots = self._slot(keys)
        while keys.size:  # of those that want one free slot the first gets it, the others go on to the next
            free = self.keys[slots] == -1
            winner = np.zeros(keys.size, dtype=bool)
            winner[np.unique(slots, return_index=True)[1]] = True
            put = free & winner
            self.keys[slots[put]], self.values[slots[put]] = keys[put], values[put]
            keys, values, slots = keys[~put], values[~put], (slots[~put] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where there is none or an id is negative (padding)."""
        shape = a.shape
        keys = ((a << 32) | b).ravel()
        out = np.full(keys.size, NONE, dtype=np.int64)
        at = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        keys = keys[at]
        slots = self._slot(keys)
        while at.size:
            found = self.keys[slots]
            hit = found == keys
            out[at[hit]] = self.values[slots[hit]]
            more = ~hit & (found != -1)
            at, keys, slots = at[more], keys[more], (slots[more] + 1) & (self.keys.size - 1)
        return out.reshape(shape)


@lru_cache(maxsize=2)
def load_ranks(path: str) -> Ranks:
    with open(path, "rb") as lines:
        return Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def merge_matrix(ranks: Ranks, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Merges the rows of ``ids`` (padded with -1); (row numbers, their ids) as rows get done."""
    done, rows = [], np.arange(ids.shape[0])
    best = ranks.pair(ids[:, :-1], ids[:, 1:])
    while rows.size:
        if best.shape[1] == 0:
            done.append((rows, ids))
            break
        j = best.argmin(axis=1)
        least = best[np.arange(rows.size), j]
        going = least < NONE
        if not going.all():
            done.append((rows[~going], ids[~going]))
            rows, ids, best, j, least = rows[going], ids[going], best[going], j[going], least[going]
            if not rows.size:
                break
        line = np.arange(rows.size)
        ids[line, j] = least
        # Each row loses one id, so the matrix loses a column.
        columns = np.arange(ids.shape[1] - 1)[None, :]
        ids = np.take_along_axis(ids, columns + (columns > j[:, None]), axis=1)
        columns = columns[:, :-1]
        best = np.take_along_axis(best, columns + (columns >= j[:, None]), axis=1)
        for at in (j - 1, j):
            ok = np.flatnonzero((at >= 0) & (at < best.shape[1]))
            best[ok, at[ok]] = ranks.pair(ids[ok, at[ok]], ids[ok, at[ok] + 1])
    return done


def merge_long(ranks: Ranks, ids: list[int]) -> list[int]:
    """The same rule for one long row: a heap of (rank, place) over linked neighbours."""
    from heapq import heapify, heappop, heappush

    n, pairs = len(ids), ranks.pairs
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := pairs.get((ids[i] << 32) | ids[i + 1])) is not None]
    heapify(heap)
    while heap:
        rank, i = heappop(heap)
        k = after[i]
        if ids[i] < 0 or k >= n or pairs.get((ids[i] << 32) | ids[k]) != rank:
            continue
        ids[i], ids[k] = rank, -1
        after[i] = after[k]
        if after[k] < n:
            before[after[k]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n and (r := pairs.get((ids[left] << 32) | ids[right])) is not None:
                heappush(heap, (r, left))
    return [i for i in ids if i >= 0]


def encode_pieces(ranks: Ranks, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces end to end, and the number of ids of each piece."""
    counts = np.zeros(len(pieces), dtype=np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    whole, known, by_width = [], [], {}
    for i, piece in enumerate(pieces):
        if (token := ranks.ids.get(piece)) is not None:
            whole.append(i)
            known.append(token)
        else:
            by_width.setdefault((len(piece) - 1).bit_length(), []).append(i)
    counts[whole] = 1
    parts.append((np.array(whole, dtype=np.int64), np.array(known, dtype=np.int64)[:, None]))
    for width, rows in by_width.items():
        if 1 << width > MATRIX_WIDTH:
            for i in rows:
                ids = np.array(merge_long(ranks, ranks.byte_ids[np.frombuffer(pieces[i], np.uint8)].tolist()))
                counts[i] = ids.size
                parts.append((np.array([i]), ids[None, :]))
            continue
        lengths = np.array([len(pieces[i]) for i in rows])
        matrix = np.full((len(rows), int(lengths.max())), -1, dtype=np.int64)
        flat = np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)
        matrix[np.arange(matrix.shape[1])[None, :] < lengths[:, None]] = ranks.byte_ids[flat]
        rows = np.array(rows)
        for which, ids in merge_matrix(ranks, matrix):
            counts[rows[which]] = (ids >= 0).sum(axis=1)
            parts.append((rows[which], ids))
    starts = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), dtype=np.uint32)
    for rows, ids in parts:
        valid = ids >= 0
        place = starts[rows][:, None] + np.arange(ids.shape[1])[None, :]
        out[place[valid]] = ids[valid]
    return out, counts


def encode_block(ranks: Ranks, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As ``encode_pieces``, with each distinct piece encoded once."""
    codes, distinct = pd.factorize(np.array(pieces, dtype=object))
    flat, counts = encode_pieces(ranks, [p.encode("utf-8", "surrogatepass") for p in distinct])
    starts = np.cumsum(counts) - counts
    sizes = counts[codes]
    ends = np.cumsum(sizes)
    index = np.repeat(starts[codes] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if ends.size else 0)
    return flat[index], sizes


def encode_texts(ranks: Ranks, texts: list[str], pattern: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    import regex

    find = regex.compile(pattern).finditer
    out = [[] for _ in texts]
    pieces: list[str] = []
    owners: list[tuple[int, int]] = []

    def flush() -> None:
        ids, sizes = encode_block(ranks, pieces)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        for text, n in owners:
            out[text].append(ids[ends[at] : ends[at + n]].astype("<u4").tobytes())
            at += n
        pieces.clear()
        owners.clear()

    for i, text in enumerate(texts):
        found = (m.group() for m in find(text))
        while new := list(islice(found, BLOCK_PIECES - len(pieces))):
            pieces += new
            owners.append((i, len(new)))
            if len(pieces) >= BLOCK_PIECES:
                flush()
    if pieces:
        flush()
    return [b"".join(x) for x in out]


def decode_ids(ranks: Ranks, ids: bytes) -> bytes:
    return b"".join(map(ranks.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(
    docs: DataFrame,
    text: str = "text",
    out: str = "ids",
    checked: str | None = None,
    vocabulary: str = VOCABULARY,
    pattern: str = PATTERN,
) -> DataFrame:
    """``docs`` without ``text``, with ``out``: token ids as little-endian unsigned 32-bit integers.

    ``checked`` names a column that tells whether the ids, decoded again, are the text. Null and empty
    texts have no ids. Other columns and repeated rows pass through, but columns named as the added
    ones are replaced; a table without rows gives none.
    """
    keep = [c for c in docs.columns if c not in (text, out, checked)]
    # Columns go by place, so that no name of the input can meet a name used here.
    plain = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")), *[F.col(f"`{c}`") for c in keep])
    plain = plain.toDF("text", *[f"c{i}" for i in range(len(keep))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(tokenizer_path(vocabulary))
        for batch in batches:
            step = max(1, BLOCK_CHARS * len(batch) // max(1, batch.column(0).nbytes))
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                texts = part.column(0).to_pylist()
                ids = encode_texts(ranks, texts, pattern)
                # The other columns stay Arrow arrays, so that no value changes beside a null.
                columns = [*part.columns[1:], pa.array(ids, pa.binary())]
                names = [*part.schema.names[1:], "ids"]
                if checked:
                    same = [decode_ids(ranks, x) == t.encode("utf-8", "surrogatepass") for x, t in zip(ids, texts, strict=True)]
                    columns.append(pa.array(same, pa.bool_()))
                    names.append("same")
                yield pa.RecordBatch.from_arrays(columns, names)

    shape = plain.drop("text").withColumn("ids", F.lit(b""))
    if checked:
        shape = shape.withColumn("same", F.lit(True))
    return plain.mapInArrow(encode, shape.schema).toDF(*keep, out, *[checked] * bool(checked))


def decoded(vocabulary: str = VOCABULARY):
    """Column function: ids as written by ``encode_documents`` to the bytes that they stand for."""

    @F.pandas_udf("binary")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ranks = load_ranks(tokenizer_path(vocabulary))
        for ids in parts:
            yield pd.Series([None if x is None else decode_ids(ranks, x) for x in ids], dtype=object)

    return decode
