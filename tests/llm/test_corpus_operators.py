"""N-gram join, components, mixing and the pipeline: against brute force and their definitions."""

from __future__ import annotations

import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import components, mixing, ngram_join
from granary.llm.components import connected_components
from granary.llm.toxicity import fit_toxicity, score_toxicity
from tests.llm.cases import CLASHING, ROWS, clashing, documents, labels


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_against_union_find(spark):
    random.seed(2)
    links = [(i, i + 1) for i in range(100, 130)] + [(500, i) for i in range(300, 400)] + [(7, 7)]
    links += [(random.randrange(1000, 1200), random.randrange(1000, 1200)) for _ in range(90)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [x for x in links if x[0] != x[1]]
    want = roots({n for x in real for n in x}, real)
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_one_large_group_contract(spark, monkeypatch):
    """A group of 10 000 near copies, chained as buckets chain them: links fall in every round."""
    random.seed(4)
    n, links = 10_000, set()
    for _ in range(20):
        low = {}
        for i in range(n):
            first = low.setdefault(random.choice([0, 0, 0, 0, random.randrange(4000)]), i)
            links |= {(i, first)} if i != first else set()
    sizes, keep = [], components.written

    def counted(df, tag):
        out = keep(df, tag)
        if tag == "links":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(components, "written", counted)
    got = connected_components(spark.createDataFrame(sorted(links), "a long, b long")).collect()
    assert {r.node: r.component for r in got} == roots({i for x in links for i in x}, links)
    assert sizes[-1] == 0 and all(b < a for a, b in zip(sizes, sizes[1:], strict=False)), sizes
    assert sizes[1] * 3 < sizes[0], sizes


def grams(text, n=5):
    words = (text or "").split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_join(rows, threshold):
    """(class id, links) by id; ids are unique."""
    sets = {i: grams(t) for i, t in rows}
    links = []
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and Fraction(both, len(sets[a] | sets[b])) >= threshold:
                links.append((a, b))
    root = roots(ids, links)
    count = dict.fromkeys(ids, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {i: (root[i], count[i]) for i in ids}


def near_copies(seed=9):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, at = [], 0
    for size in (1, 1, 2, 3, 25, 60):
        base = random.choices(vocabulary, k=random.choice([60, 120]))
        for _ in range(size):
            words = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 4, 8])):
                words[random.randrange(len(words))] = random.choice(vocabulary)
            rows.append((at, " ".join(words)))
            at += 1
    rows += [(at, "a b c"), (at + 1, "a  b\tc"), (at + 2, "a b"), (at + 3, ""), (at + 4, None), (at + 5, "a b c")]
    return rows


@pytest.mark.parametrize("block", [4, 256])
def test_ngram_join_against_brute_force(spark, block):
    rows = near_copies()
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = ngram_join.jaccard_classes(df, block_documents=block).collect()
    assert {r._k_id: (r.keep_id, r.n_links) for r in out} == brute_join(rows, Fraction("0.8"))


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999, 256)
    assert bands * rows <= 256 and 1 - (1 - 0.8**rows) ** bands >= 0.9999
    with pytest.raises(ValueError, match="recall"):
        ngram_join.choose_bands(0.1, 0.9999, 8)


def test_ngram_join_odd_rows(spark):
    out = ngram_join.jaccard_classes(clashing(documents(spark))).collect()
    assert len(out) == len(ROWS)
    links = {}
    for r in out:
        links.setdefault(None if r._k_null else r._k_id, []).append((r.n_links, None if r.keep_null else r.keep_id))
    assert links[1] == [(3, 1)] and links[2] == [(3, 1), (3, 1)] and links[3] == [(3, 1)]
    assert links[4] == [(0, 4)] and links[5] == [(0, 5)] and links[6] == [(0, 6)]
    assert ngram_join.jaccard_classes(documents(spark, [])).count() == 0
    left = ngram_join.one_per_class(documents(spark))
    assert sorted(r.doc_id or -1 for r in left.collect()) == [-1, -1, 1, 4, 5, 6, 7, 8, 9, 10]


def test_whole_documents_meet_their_targets(spark):
    """Sources of a few hundred documents, sizes from 1 to 3000 words, and one of a single long document."""
    random.seed(6)
    rows = [(s * 1000 + i, "w " * int(10 ** random.uniform(0, 3.5)), None, f"s{s}", None) for s in range(4) for i in range(300)]
    rows += [(9000 + i, "w " * 400, None, None, None) for i in range(40)] + [(9999, "w " * 20_000, None, "single", None)]
    docs = documents(spark, rows)
    targets = {r.source: r for r in mixing.source_targets(mixing.sized_documents(docs)).collect()}
    copies = {(r.source, r.doc_id): r.copies for r in mixing.document_copies(docs).collect()}
    assert len(copies) == len(rows) and set(copies.values()) <= {0, 1, 2, 3}
    took = {}
    for i, text, _, source, _ in rows:
        took[source] = took.get(source, 0) + copies[(source, i)] * len(text.split())
    for source, t in targets.items():
        assert abs(took[source] - t.target) <= (0.03 * t.target if source != "single" else 20_000)
    again = {(r.source, r.doc_id): r.copies for r in mixing.document_copies(docs.repartition(7)).collect()}
    assert again == copies


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation_is_a_bijection(spark, n):
    df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit("s")).alias("y"))
    assert sorted(r.y for r in df.collect()) == list(range(n))


def test_permutation_like_plain_python(spark):
    """The same rounds written as a loop over values that Spark hashed."""
    n, seed = 41, 5
    keys = {r.r: r.k for r in spark.range(1, mixing.ROUNDS + 1).select(F.col("id").cast("int").alias("r"), F.pmod(F.xxhash64(F.lit(seed), F.col("id").cast("int")), F.lit(n).cast("long")).alias("k")).collect()}
    coins = {
        (r.r, r.m): r.c
        for r in spark.range(1, mixing.ROUNDS + 1)
        .select(F.col("id").cast("int").alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("m"))
        .select("r", "m", F.pmod(F.xxhash64("m", "r", F.lit(seed)), F.lit(2).cast("long")).alias("c"))
        .collect()
    }
    got = {r.id: r.y for r in spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(seed)).alias("y")).collect()}
    for x, y in got.items():
        for r in range(1, mixing.ROUNDS + 1):
            mirror = (keys[r] - x) % n
            if coins[r, max(x, mirror)] == 1:
                x = mirror
        assert x == y


def shares(sizes):
    """Targets by the definition: share by weight, stop at three times the size, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total = Fraction(sum(sizes.values()))
    target, stopped = {}, set()
    while True:
        free = [s for s in order if s not in stopped]
        left = total - sum(3 * sizes[s] for s in stopped)
        target = {s: Fraction(3 * sizes[s]) if s in stopped else left * weight[s] / sum(weight[x] for x in free) for s in order}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return target
        stopped.update(over)


@pytest.mark.parametrize("seed", range(3))
def test_targets_against_definition(spark, seed):
    random.seed(seed)
    sizes = {s: random.choice([1, 5, 60, 400, 9000]) for s in [None, "", "a", "Z", "é", "b", "zz"]}
    df = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "doc_id long, source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx({s: float(t) for s, t in shares(sizes).items()})


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mixed_documents(docs).toPandas()
    assert (out.taken <= 3 * out["size"]).all() and len(out) == docs.count()
    per = out.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), own=("source_size", "first"))
    assert (per["size"] == per.own).all()
    assert ((per.taken - per.target).abs() / per.target).max() < 0.03
    words = duckdb.sql("select doc_id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    assert dict(words) == dict(zip(out.doc_id, out["size"], strict=True))


def test_mix_plan_is_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sized, sources, plan = mixing.mix(docs, block_words=16, shard_blocks=50)
    pdf = plan.toPandas()
    slots = pdf.groupby(["shard", "slot"]).words.sum()
    assert slots.max() <= 16 and slots.index.get_level_values(1).max() < 50
    last = slots.index.get_level_values(0).max()
    full = slots.groupby(level=0).size()
    assert (full.drop(last) == 50).all()  # every slot of every shard is dealt once
    size = dict(sized.select("row", "size").collect())
    assert all(0 <= r["from"] and r["from"] + r.words <= size[r.row] for _, r in pdf.iterrows())


def test_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = {tuple(r) for r in mixing.mixed_documents(docs).drop("tag").collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = {tuple(r) for r in mixing.mixed_documents(docs.repartition(5)).drop("tag").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert first == again


def test_mix_odd_rows(spark):
    out = mixing.mixed_documents(clashing(documents(spark)))
    assert out.count() == len(ROWS)
    assert {r.taken for r in out.collect() if r.doc_id in (4, 5, 6)} == {0}
    assert mixing.mixed_documents(documents(spark, [])).count() == 0
    wordless = documents(spark, [(1, None, "en", "a", 0), (2, "", "en", None, 0)])
    assert {(r.size, r.taken, r.target) for r in mixing.mixed_documents(wordless).collect()} == {(0, 0, 0.0)}


def sf_dir(tmp_path_factory, spark, rows=((7, 0, 1), (1, 1, 0))):
    path = str(tmp_path_factory.mktemp("sf"))
    labels(spark, rows).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("rows", [None, []])
def test_stages_take_odd_rows(spark, tmp_path_factory, rows):
    place = sf_dir(tmp_path_factory, spark)
    docs = clashing(documents(spark, rows))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, place)
        path = str(tmp_path_factory.mktemp(name)) + "/t"
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if i < 4:
            assert after.columns == docs.columns
        else:
            assert {"n_tokens", "decodes", "ids"} <= set(after.columns) and set(CLASHING) - {"ids", "n_tokens"} <= set(after.columns)
        docs = after
    if rows is None:
        assert docs.count() > 0 and docs.where("not decodes").count() == 0
    else:
        assert docs.count() == 0


def test_pipeline_against_brute_force(spark):
    """Each stage beside a plain version over what the stage before kept."""
    place = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{place}/documents.parquet")
    read = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    known = spark.read.parquet(f"{place}/labels.parquet")
    clean = corpus_pipeline.written(corpus_pipeline.toxicity(spark, docs, place), "t1")
    scores = score_toxicity(docs, fit_toxicity(docs, known)).collect()
    assert set(read(clean)) == {r.doc_id for r in scores if r.score < 0.5}

    lines = corpus_pipeline.written(corpus_pipeline.line_dedup(spark, clean, place), "t2")
    before, holders = read(clean), {}
    fold = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    for i in sorted(before):
        for line in before[i].split("\n"):
            holders.setdefault(fold(line), []).append(i)
    seen, want = set(), {}
    for i in sorted(before):
        kept = []
        for line in before[i].split("\n"):
            key = fold(line)
            often = key and len(set(holders[key])) >= 10
            if not often or key not in seen:
                kept.append(line)
            if often:
                seen.add(key)
        want[i] = "\n".join(kept)
    assert read(lines) == want

    single = corpus_pipeline.written(corpus_pipeline.near_duplicates(spark, lines, place), "t3")
    classes = brute_join(list(want.items()), Fraction("0.8"))
    assert set(read(single)) == {i for i, (first, _) in classes.items() if first == i}

    mixed = corpus_pipeline.written(corpus_pipeline.source_mix(spark, single, place), "t4")
    copies = {r.doc_id: r.copies for r in mixing.document_copies(single).collect()}
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in copies.items() if n} and max(copies.values()) <= 3

    tokens = corpus_pipeline.byte_bpe(spark, mixed, place).collect()
    assert len(tokens) == sum(got.values()) and all(r.decodes for r in tokens)
    from granary.llm import bpe
    from granary.llm.common import tokenizer_path

    ranks = bpe.load_ranks(tokenizer_path(bpe.VOCABULARY))
    texts = read(single)
    for r in tokens[:50]:
        assert b"".join(ranks.tokens[i] for i in np.frombuffer(r.ids, "<u4")) == texts[r.doc_id].encode()
