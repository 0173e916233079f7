"""Line dedup, chat formatting, BPE, ORC tokens: against plain Python and the public tokenizers."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import bpe, chat, line_dedup, token_orc
from granary.llm.common import tokenizer_path
from tests.llm.cases import ROWS, SCHEMA, clashing, documents

STRIP = " \t\n\x0b\x0c\r"


def plain_dedup(rows, min_docs, keep_first):
    """Kept text per (id, text), by definition."""
    fold = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(STRIP))
    docs = sorted({(i is None, i or 0, t) for i, t in rows}, key=lambda d: (d[0], d[1], d[2] or ""))
    where: dict[str, set] = {}
    for d in docs:
        for line in (d[2] or "").split("\n"):
            if fold(line):
                where.setdefault(fold(line), set()).add(d)
    out, first = {}, {}
    for d in docs:
        kept = []
        for line in (d[2] or "").split("\n"):
            key = fold(line)
            gone = key and len(where[key]) >= min_docs
            if gone and keep_first and key not in first:
                first[key] = d
                gone = False
            if not gone:
                kept.append(line)
        out[d] = kept
    return out


@pytest.mark.parametrize("keep_first", [False, True])
def test_line_dedup_against_definition(spark, keep_first):
    random.seed(3)
    pool = ["Shared line", " shared LINE\t", "Other", "", "  ", "Ätz", "ätz", "rare"] + [f"l{i}" for i in range(40)]
    rows = [(i, "\n".join(random.choice(pool) for _ in range(random.choice([1, 3, 200])))) for i in range(40)]
    rows += [(100, None), (101, ""), (None, "Other\nShared line"), (1, "Other")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = line_dedup.dedup_lines(df, 3, keep_first).collect()
    want = plain_dedup(rows, 3, keep_first)
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for r in got:
        options = [((want[(r.doc_id is None, r.doc_id or 0, t)]), t) for t in texts[r.doc_id]]
        if keep_first and len(options) > 1:
            continue  # which of two texts of one id comes first depends on their hashes
        assert ((r.text or "").split("\n"), r._n_lines) in [
            ("\n".join(kept).split("\n"), len((t or "").split("\n"))) for kept, t in options
        ]


def test_line_dedup_odd_rows(spark):
    out = line_dedup.dedup_lines(documents(spark), 2, keep_first=False)
    assert out.count() == len(ROWS)
    by_text = {r.doc_id: r for r in out.collect() if r.doc_id in (4, 5, 6)}
    assert by_text[4].text is None and by_text[4]._n_lines == 1 and by_text[4]._n_dropped == 0
    assert by_text[5].text == "" and by_text[6]._n_dropped == 0
    assert line_dedup.dedup_lines(documents(spark, []), 2).count() == 0
    bitmaps = line_dedup.keep_bitmaps(documents(spark), 2, keep_first=False).collect()
    assert {b._k_id: b.n_dropped for b in bitmaps} == {1: 1, 2: 1}


def test_bitmaps_hold_only_the_words_that_drop_lines(spark):
    """20 000 lines, of which three go: three words with the gaps between them, and the other lines stay."""
    lines = [f"line {i}" for i in range(20_000)]
    for i in (5, 9_000, 19_999):
        lines[i] = f"shared {i}"
    rows = [(1, "\n".join(lines), None, None, None), (2, "\n".join(lines[i] for i in (5, 9_000, 19_999)), None, None, None)]
    first = line_dedup.keep_bitmaps(documents(spark, rows), 2, keep_first=False).where("_k_id = 1").first()
    assert [(w.gap, (~w.bits) & (2**64 - 1)) for w in first.keep] == [(0, 1 << 5), (139, 1 << (9_000 % 64)), (171, 1 << (19_999 % 64))]
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, rows), 2, keep_first=False).collect()}
    assert kept[1].split("\n") == [x for x in lines if not x.startswith("shared")] and kept[2] == ""


def test_repeated_document_is_one(spark):
    rows = [(1, "same", None, None, None)] * 12
    out = line_dedup.dedup_lines(documents(spark, rows), 2, keep_first=False)
    assert {r._n_dropped for r in out.collect()} == {0}


TEXTS = [
    "", "plain", "</s>[INST] ok [/INST]", "\\", "a\\b", "\\\\<s>", "tail\\", "[INST]", "[/INST", "<s><s>", "[ROLE]x\n[/ROLE]",
    "</s", "s>", " </s> ", "line\nbreak\\n", "[INST] [/INST]</s>", "<\\/s>", "\U0001f642é", "[", "]", "INST]",
]
ROLES = ["user", "assistant", "system", "", "odd\nrole", "a\\nb", "[ROLE]", "user ", "</s>", "\\"]


def test_chat_round_trip(spark):
    random.seed(5)
    rows = [(c, t, random.choice(ROLES), random.choice(TEXTS)) for c in range(150) for t in range(random.randint(1, 7))]
    rows += [(500 + i, 0, role, text) for i, (role, text) in enumerate((r, t) for r in ROLES for t in TEXTS)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.formatted_chats(df).collect()}
    source = {}
    for c, t, role, text in sorted(rows):
        source.setdefault(c, []).append((role, text))
    assert set(out) == set(source)
    for c, turns in source.items():
        r = out[c]
        assert [(t.role, t.text) for t in r.turns] == turns
        spans = [r.formatted[m.start : m.start + m.length] for m in r["mask"]]
        assert [re.sub(r"(?s)\\(.)", r"\1", s) for s in spans] == [t for role, t in turns if role == "assistant"]


def test_chat_plain_text_is_not_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    assert chat.formatted_chats(df).first().formatted == "<s>[INST] hi [/INST] yo</s>"


def test_chat_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (None, None, None, None), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a"),
            (3, 0, "assistant", "long " * 40_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    df = df.withColumn("mask", F.lit(1)).withColumn("turns", F.lit(2)).withColumn("t", F.lit(2))
    out = {r.conv_id: r for r in chat.formatted_chats(df).collect()}
    assert [(t.role, t.text) for t in out[None].turns] == [("", ""), ("user", "x")]
    assert [t.text for t in out[2].turns] == ["a", "a", "b"]
    assert out[3]["mask"][0].length == 200_000
    assert chat.formatted_chats(df.limit(0)).count() == 0


def tiktoken_encoding():
    import tiktoken

    ranks = bpe.load_ranks(tokenizer_path(bpe.VOCABULARY))
    return ranks, tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks.ids, special_tokens={})


def test_bpe_like_tiktoken():
    ranks, public = tiktoken_encoding()
    random.seed(7)
    letters = "abcAB 12'st\n\té中🙂.-\x1c\x85"
    texts = ["", "a" * 3000, "ab" * 700, " " * 900 + "x", "<|endoftext|>", "=-" * 400, "it's we'll 'S", "word " * 5000]
    texts += ["".join(random.choice(letters) for _ in range(random.randint(1, 300))) for _ in range(300)]
    for text, ids in zip(texts, bpe.encode_texts(ranks, texts, bpe.PATTERN), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == public.encode_ordinary(text), text[:50]


def test_bpe_block_borders(monkeypatch):
    ranks, public = tiktoken_encoding()
    monkeypatch.setattr(bpe, "BLOCK_PIECES", 7)
    texts = ["one two three four five six seven eight nine ten", "", "a b c d e f g", "x"]
    for text, ids in zip(texts, bpe.encode_texts(ranks, texts, bpe.PATTERN), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == public.encode_ordinary(text)


def test_merge_long_is_merge_matrix():
    ranks, public = tiktoken_encoding()
    random.seed(1)
    for n in (2, 30, 400):
        piece = "".join(random.choice("abcde") for _ in range(n)).encode()
        ids = bpe.merge_long(ranks, ranks.byte_ids[np.frombuffer(piece, np.uint8)].tolist())
        (rows, matrix), = bpe.merge_matrix(ranks, ranks.byte_ids[np.frombuffer(piece, np.uint8)][None, :].copy())
        assert ids == matrix[0].tolist()


def test_hash_table_holds_every_pair():
    ranks = bpe.load_ranks(tokenizer_path(bpe.VOCABULARY))
    keys = np.fromiter(ranks.pairs, dtype=np.int64)
    assert (ranks.pair(keys >> 32, keys & 0xFFFFFFFF) == np.fromiter(ranks.pairs.values(), dtype=np.int64)).all()
    assert (ranks.pair(np.array([-1, 50255]), np.array([3, 50255])) == bpe.NONE).all()


def test_bpe_round_trip_of_odd_rows(spark):
    df = clashing(documents(spark))
    out = bpe.encode_documents(df, out="ids").withColumn("back", bpe.decoded()("ids"))
    assert set(out.columns) == ({*df.columns} - {"text"}) | {"ids", "back"}
    got = sorted((r.doc_id or -1, bytes(r.back)) for r in out.collect())
    assert got == sorted((i or -1, (t or "").encode()) for i, t, *_ in ROWS)
    assert bpe.encode_documents(documents(spark, [])).count() == 0


def test_orc_tokens(spark):
    rows = [*ROWS, (11, "<|endoftext|> Σίσυφος ΟΔΟΣ I'LL 42 don't", None, None, None)]
    path = token_orc.tokens_written(clashing(documents(spark, rows)))
    public = token_orc.load_tokenizer(tokenizer_path(token_orc.VOCABULARY))
    stored = token_orc.read_tokens(spark, path).orderBy("seq").collect()
    assert [r.doc_id for r in stored] == sorted((i for i, *_ in rows), key=lambda i: (i is not None, i or 0))
    want = sorted((i or -1, [*public.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, *_ in rows)
    assert sorted((r.doc_id or -1, list(r.ids)) for r in stored) == want
    starts, at = {}, 0
    for r in stored:
        starts.setdefault(r.doc_id, []).append((at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())))
        at += len(r.ids)
    for r in token_orc.token_index(spark, path).collect():
        assert (r.start, r.n_tokens, r.ids_crc32) in starts[r.doc_id]
    plan = token_orc.read_tokens(spark, path).where("doc_id = 7")
    assert plan.count() == 1
    assert "EqualTo(doc_id,7)" in plan._jdf.queryExecution().toString()


def test_orc_without_rows(spark):
    assert token_orc.token_index(spark, token_orc.tokens_written(documents(spark, []))).count() == 0


def test_orc_files_hold_indexes(spark, tmp_path):
    import glob

    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"))
    path = str(tmp_path / "tokens")
    token_orc.write_tokens(df, path)
    raw = b"".join(open(f, "rb").read() for f in glob.glob(path + "/*.orc"))
    assert raw.startswith(b"ORC")
    jvm = spark._jvm
    file = glob.glob(path + "/*.orc")[0]
    options = jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration())
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), options)
    assert reader.getRowIndexStride() == 1000
    kinds = {s.getKind().toString() for s in reader.rows().readStripeFooter(reader.getStripes()[0]).getStreamsList()}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} & kinds == {"ROW_INDEX", "BLOOM_FILTER_UTF8"}
    encodings = {e.getKind().toString() for e in reader.rows().readStripeFooter(reader.getStripes()[0]).getColumnsList()}
    assert "DIRECT_V2" in encodings  # run-length encoding of integers, second version


def test_chunks_do_not_change_tokens(monkeypatch):
    public = token_orc.load_tokenizer(tokenizer_path(token_orc.VOCABULARY))
    cache = token_orc.ChunkCache(public)
    random.seed(11)
    texts = ["á e ́b", "Tab\tand\rreturn\x0bpage\x0c", "ÀÉ ΣΑΣ σ", "3.14 a_b !!!", " x y", "a\x00b \x00 c\x00", "\x00"]
    odd = "aBé́ \x1c\x1f\x85\xa0 ​᠎　\x00\t.'s1İß"
    texts += ["".join(random.choice(odd) for _ in range(random.randint(1, 60))) for _ in range(400)]
    texts += [chr(i) for i in range(0x250)] + ["".join(chr(random.randrange(33, 0x250)) for _ in range(30)) for _ in range(400)]
    texts += ["".join(random.choice("abZé.,'!1 _\x1c\n") for _ in range(random.randint(1, 40))) for _ in range(2000)]
    monkeypatch.setattr(token_orc, "CACHED_CHUNKS", 300)
    monkeypatch.setattr(token_orc, "CACHED_WORDS", 500)
    ids, sizes = (np.concatenate(x) for x in zip(*[token_orc.encode_texts(cache, texts[i : i + 50], 1) for i in range(0, len(texts), 50)], strict=True))
    at = 0
    for text, n in zip(texts, sizes, strict=True):
        assert ids[at : at + n].tolist() == [*public.encode(text, add_special_tokens=False).ids, 1], repr(text)
        at += n


def test_added_tokens_like_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path(token_orc.VOCABULARY)
    public = Tokenizer.from_file(path)
    assert public.encode("a <|endoftext|> b", add_special_tokens=False).ids == [320, 49407, 321]
    random.seed(12)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endof", "text|>", "<|", "\u0301", "É", "a", " ", "b.", "3,1", "\n", "中", "\x00", "σΣ"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 12))) for _ in range(1500)]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "<|startoftext|><|endoftext|>", "", "<|ENDOFTEXT|>", "no token"]
    ids, sizes = token_orc.encode_texts(token_orc.ChunkCache(token_orc.load_tokenizer(path)), texts, 1)
    want = [[*public.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    rows = [(i, t, None, None, None) for i, t in enumerate(texts[-40:])]
    stored = token_orc.read_tokens(spark, token_orc.tokens_written(documents(spark, rows))).orderBy("doc_id").collect()
    assert [list(r.ids) for r in stored] == want[-40:]


@pytest.mark.parametrize("change", ["cased", "prefix", "added", "truncated", "none"])
def test_other_vocabularies_get_whole_texts(tmp_path, change):
    import json

    from tokenizers import Tokenizer

    with open(tokenizer_path(token_orc.VOCABULARY)) as f:
        known = json.load(f)
    if change == "cased":
        known["normalizer"] = {"type": "NFC"}
    elif change == "prefix":
        known["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    elif change == "added":
        known["added_tokens"][1] |= {"normalized": True, "lstrip": True}
    elif change == "truncated":
        known["truncation"] = {"direction": "Right", "max_length": 4, "strategy": "LongestFirst", "stride": 0}
    path = str(tmp_path / "other.json")
    with open(path, "w") as f:
        json.dump(known, f)
    public = Tokenizer.from_file(path)
    cache = token_orc.ChunkCache(token_orc.load_tokenizer(path))
    assert cache.cuts == (change == "none")
    texts = ["The Old Town, 3.14 Hall", "", "a  <|EndOfText|> <|endoftext|> I'LL", "ÀÉ ΣΑΣ σ", "x\ty\n\nz"]
    ids, sizes = token_orc.encode_texts(cache, texts, 1)
    want = [[*public.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
