"""Token ids in ORC files: run-length encoded integers, row indexes, Bloom filters on the document id."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import batch_rows, running_start, shuffle_partitions, tokenizer_path
from granary.session import shared_dir, written

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
BATCH_ROWS = 500
CACHED_CHUNKS, CACHED_WORDS, JOINED_PARTS = 200_000, 50_000, 500
#: A character that is a token of its own and hardly occurs in texts.
MARK = "\x00"
#: Stripes of 16 MB can be read in parallel; an index entry and a Bloom filter for every 1000 documents.
ORC_OPTIONS = {
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "compression": "snappy",
}
#: The tokenizer's own pattern for words (fixed value), used on lower-cased Latin chunks.
LATIN_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The normalizer and splitter that texts are cut for here; other tokenizers are given whole texts.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}
    ],
}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": LATIN_WORDS.pattern}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Kinds of the Latin-1 characters: letters and digits, white space, full stops and commas, other signs.
#: Four control characters that Python takes for white space are signs to the tokenizer.
KINDS = bytes(
    ord(" " if chr(i).isspace() and not 0x1C <= i <= 0x1F else "." if chr(i) in ".," else "a" if chr(i).isalnum() else "#") for i in range(256)
)


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    """The tokenizer as the library reads it; strings of its added tokens inside a text are those tokens."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cuts_alike(tokenizer) -> bool:
    """Whether the tokenizer normalizes and splits as ``NORMALIZER`` and ``SPLITTER`` do, with plain added tokens."""
    stages = ((tokenizer.normalizer, NORMALIZER), (tokenizer.pre_tokenizer, SPLITTER))
    return (
        all(own is not None and json.loads(own.__getstate__()) == known for own, known in stages)
        and tokenizer.truncation is None
        and tokenizer.padding is None
        and not any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in tokenizer.get_added_tokens_decoder().values())
        and len(tokenizer.encode(MARK, add_special_tokens=False).ids) == 1
    )


class ChunkCache:
    """Ids of chunks seen by this worker, as flat arrays.

    A chunk of Latin letters and signs is lower-cased and cut into the tokenizer's words, of which
    there are far fewer; the tokenizer encodes each distinct word once. Other chunks are given to it
    as they are. Both caches stop growing at a fixed number of entries. A tokenizer that cuts texts
    in another way (``cuts`` is false) has to be given whole texts.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.cuts = cuts_alike(tokenizer)
        self.mark = tokenizer.encode(MARK, add_special_tokens=False).ids
        self.added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.any_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.words: dict[str, bytes] = {}
        self.place: dict[str, int] = {}
        self.flat, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def parted(self, texts: list[str], end_id: int) -> tuple[list[str], list[int], list[int]]:
        """The texts' parts between added tokens, the id behind each part, and the number of parts per text.

        The tokenizer takes added tokens out before anything else, in the case they are written in, and
        handles what is between them as texts of their own.
        """
        parts, behind, counts = [], [], []
        for text in texts:
            own = self.any_added.split(text) if any(map(text.__contains__, self.added)) else [text]
            parts += own[::2]
            behind += [*map(self.added.__getitem__, own[1::2]), end_id]
            counts.append(len(own) // 2 + 1)
        return parts, behind, counts

    def encode_new(self, parts: list[str]) -> Iterator[bytes]:
        """Ids per part: many parts are encoded as one text and told apart by a mark between them."""
        groups = [parts[at : at + JOINED_PARTS] for at in range(0, len(parts), JOINED_PARTS)]
        texts = [f" {MARK} ".join(g) for g in groups]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype=np.int32)
            cuts = np.flatnonzero(ids == self.mark[0]).tolist()
            if len(self.mark) == 1 and len(cuts) == len(group) - 1:
                raw = ids.tobytes()
                for a, b in zip([-1, *cuts], [*cuts, ids.size], strict=True):
                    yield raw[4 * a + 4 : 4 * b]
            else:  # a part that holds the mark itself
                for part in group:
                    yield np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, np.int32).tobytes()

    def words_of(self, chunk: str) -> list[str]:
        if not chunk:
            return []
        low = chunk.lower()
        # Up to here no letter combines with another, and each lower-cases alone.
        if chunk.isascii() or (max(chunk) < "\u0250" and len(low) == len(chunk)):
            return [low] if low.isalpha() else LATIN_WORDS.findall(low)
        return [chunk]

    def encode(self, chunks: list[str], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``chunks[at]`` end to end and the number of each; ``chunks`` are distinct."""
        codes = np.fromiter(map(self.place.get, chunks, repeat(-1)), np.int64, len(chunks))
        unknown = np.flatnonzero(codes < 0)
        known, words = len(self.place), self.words
        new = [chunks[i] for i in unknown.tolist()]
        cut = [self.words_of(c) for c in new]
        missing = {w for ws in cut for w in ws if w not in words}
        # A word of a-z is itself to the tokenizer's normalizer and splitter: its model alone is left to ask.
        tokenize = self.tokenizer.model.tokenize
        plain = [w for w in missing if w.isascii() and w.isalpha()]
        fresh = {w: array("i", [t.id for t in tokenize(w)]).tobytes() for w in plain}
        other = [w for w in missing if w not in fresh]
        fresh.update(zip(other, self.encode_new(other), strict=True))
        if len(words) + len(fresh) <= CACHED_WORDS:
            words.update(fresh)
        encoded = [b"".join([words[w] if w in words else fresh[w] for w in ws]) for ws in cut]
        counts = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(encoded), np.int32)])
        bounds = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        codes[unknown] = np.arange(known, known + len(new))
        if known + len(new) <= CACHED_CHUNKS:
            self.place.update(zip(new, range(known, known + len(new)), strict=True))
            self.flat, self.starts = flat, bounds
        starts = bounds[codes]
        lengths = (bounds[codes + 1] - starts)[at]
        ends = np.cumsum(lengths)
        index = np.repeat(starts[at] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if ends.size else 0)
        return flat[index], lengths


@lru_cache(maxsize=2)
def load_cache(path: str) -> ChunkCache:
    return ChunkCache(load_tokenizer(path))


def cuttable(text: str) -> str:
    """The text, ready to be cut at white space into parts that the tokenizer handles apart from each other.

    Latin texts are lower-cased, and their full stops and commas beside letters and digits stand apart,
    which leaves far fewer distinct parts.
    """
    low = text.lower()
    try:
        kinds = low.encode("latin-1").translate(KINDS)
    except UnicodeEncodeError:
        return text
    if len(low) != len(text) or any(x in kinds for x in (b"..", b".#", b"#.")):
        return text
    return low.replace(".", " . ").replace(",", " , ")


def encode_texts(cache: ChunkCache, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, each closed by ``end_id``, and their number per text."""
    if not cache.cuts:
        whole = [[*cache.tokenizer.encode(t, add_special_tokens=False).ids, end_id] for t in texts]
        return np.array(list(chain.from_iterable(whole)), np.int32), np.array(list(map(len, whole)), np.int64)
    parts, behind, counts = cache.parted(texts, end_id)
    chunks = pc.ascii_split_whitespace(pa.array([cuttable(p) for p in parts], pa.string()))
    coded = chunks.flatten().dictionary_encode()
    ids, lengths = cache.encode(coded.dictionary.to_pylist(), coded.indices.to_numpy())
    ends = np.concatenate([[0], np.cumsum(lengths)])
    totals = np.diff(ends[chunks.offsets.to_numpy()]) + 1
    closing = np.zeros(ids.size + len(parts), dtype=bool)
    closing[np.cumsum(totals) - 1] = True
    out = np.empty(closing.size, dtype=np.int32)
    out[closing], out[~closing] = behind, ids
    return out, np.add.reduceat(totals, np.cumsum([0, *counts[:-1]]))


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Writes ``seq``, ``doc_id`` and ``ids`` (array<int>) as ORC files below ``path``.

    Files and their rows follow ascending doc_id (null first; ties by the text's hash), and ``seq``
    grows along them: its upper bits are the file's number. Null and empty texts have the end id
    alone; repeated rows are written again; other columns are not read. A table without rows writes
    a file without rows.
    """
    n = shuffle_partitions(docs.sparkSession)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("tag", F.xxhash64("text"))
        .repartitionByRange(n, "doc_id", "tag")
        .sortWithinPartitions("doc_id", "tag")
        .select("doc_id", "text")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = load_cache(tokenizer_path(vocabulary))
        for batch in batches:
            for part in blocks(batch):
                ids, sizes = encode_texts(cache, part.column("text").to_pylist(), end_id)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])

    encoded = ordered.mapInArrow(encode, "doc_id long, ids array<int>")
    with batch_rows(docs.sparkSession, BATCH_ROWS):
        encoded.select(F.monotonically_increasing_id().alias("seq"), "doc_id", "ids").write.options(**ORC_OPTIONS).orc(path)


def blocks(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most_bytes`` of text each."""
    step = max(1, most_bytes * batch.num_rows // max(1, batch.column("text").nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files as ``seq, doc_id, ids``; filters on doc_id reach the indexes and Bloom filters."""
    return spark.read.schema("seq long, doc_id long, ids array<int>").orc(path)


def token_digests(tokens: DataFrame) -> DataFrame:
    """Per row of the files: seq, doc_id, ``n_tokens`` and ``ids_crc32`` (ids as little-endian 32-bit integers)."""
    import zlib

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("seq"),
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets).astype(np.int64)),
                    pa.array(crcs, pa.int64()),
                ],
                names=["seq", "doc_id", "n_tokens", "ids_crc32"],
            )

    return tokens.mapInArrow(digest, "seq long, doc_id long, n_tokens long, ids_crc32 long")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ``start`` (ids of all rows before it in the files), n_tokens and ids_crc32, read from the files."""
    with batch_rows(spark, BATCH_ROWS):
        rows = written(token_digests(read_tokens(spark, path)), "token-digests")
    rows = rows.withColumn("part", F.expr("shiftright(seq, 33)"))
    placed = running_start(rows, [], "part", ["seq"], "n_tokens", "start")
    return placed.select("doc_id", F.col("start").cast("long").alias("start"), "n_tokens", "ids_crc32")


def tokens_written(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> str:
    """Writes the documents' tokens to a new folder of the shared place, and returns the folder."""
    path = shared_dir(docs.sparkSession, "token-orc")
    write_tokens(docs, path, vocabulary, end_id)
    return path
