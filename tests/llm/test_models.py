"""Toxicity, quality, line labelling, nearest neighbours: held-out accuracy, recall, brute force."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granary.llm import hnsw, line_crf, linear, quality, toxicity
from granary.llm.queries import QUERIES
from tests.llm.cases import ROWS, clashing, documents, labels

SF = "/root/testdata/sf0.01"


def auc(y, s):
    ranks = pd.Series(s).rank().to_numpy()
    n, p = len(y), int((y == 1).sum())
    return (ranks[y == 1].sum() - p * (p + 1) / 2) / (p * (n - p))


@pytest.mark.parametrize(("name", "label", "least"), [("op1_toxicity", "toxic", 0.9), ("op4_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    got = QUERIES[name](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    both = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert both.score.between(0, 1).all()
    held = both[both.held_out]
    assert auc(held[label].to_numpy(), held.score.to_numpy()) >= least
    assert (held.predicted == held[label]).mean() >= 0.9


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400")
    own = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = own.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit_toxicity(docs, own), toxicity.fit_toxicity(docs, turned)
    assert a.features == b.features and np.allclose(a.weights, b.weights)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = own.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit_quality(docs, own), quality.fit_quality(docs, turned)
    assert np.allclose(a.weights, b.weights) and np.allclose(a.levels, b.levels)


def test_label_model_finds_rates_and_correlations(spark):
    random = np.random.default_rng(2)
    n, voters = 20_000, 6
    y = random.random(n) < 0.2
    rates = np.array([[0.02, 0.05, 0.1, 0.02, 0.03, 0.03], [0.8, 0.7, 0.6, 0.5, 0.7, 0.7]])
    fires = random.random((n, voters)) < rates[y.astype(int)]
    fires[:, 5] = fires[:, 4]  # a copy of another voter
    votes = (fires * (1 << np.arange(voters))).sum(axis=1)
    rows = pd.Series(votes).value_counts()
    df = spark.createDataFrame([(int(v), None, int(c)) for v, c in rows.items()], "votes long, toxic int, rows long")
    model = toxicity.fit_label_model(df, voters)
    # The doubled voter counts twice while the rates are estimated, hence the room.
    assert np.abs(model.rates - rates).max() < 0.12 and abs(model.prior - 0.2) < 0.05
    assert model.correlations[4, 5] > 0.95 and np.abs(model.correlations[:4, :4] - np.eye(4)).max() < 0.3
    # The copy adds nothing to the vote of its original.
    assert model.posterior(np.array([1 << 4]))[0] == pytest.approx(model.posterior(np.array([3 << 4]))[0], abs=0.02)


def test_classifier_learns_posteriors_of_all_rows(spark, monkeypatch):
    docs, own = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400"), spark.read.parquet(f"{SF}/labels.parquet")
    fit, found = toxicity.fit_label_model, []
    monkeypatch.setattr(toxicity, "fit_label_model", lambda *given: found.append(fit(*given)) or found[-1])
    monkeypatch.setattr(toxicity, "CLASSIFIER_ROWS", 50, raising=False)
    model = toxicity.fit_toxicity(docs, own)
    families = model.features.families()
    seen = [toxicity.featurize(r.text, model.features, families) for r in docs.collect()]
    n = len(model.weights)
    x = np.zeros((len(seen), n + 1))
    for row, (hits, _) in enumerate(seen):
        x[row, hits] = 1
    x[:, n] = 1
    target = found[0].posterior(np.array([votes for _, votes in seen]))
    want = linear.fit_logistic(x, target, np.ones(len(seen)), np.append(np.ones(n), 1e-6), np.zeros(n + 1))
    assert len(seen) > 300 and np.allclose([*model.weights, model.bias], want, atol=1e-5)


def test_scores_of_odd_rows(spark):
    known = [(1, 1, 0), (2, 1, 0), (7, 0, 1), (7, 1, 0), (None, 1, 1), (9, None, None), (999, 0, 1)]
    for docs in (documents(spark), clashing(documents(spark))):
        for model, score in (
            (toxicity.fit_toxicity(docs, labels(spark, known)), toxicity.score_toxicity),
            (quality.fit_quality(docs, labels(spark, known)), quality.score_quality),
        ):
            out = score(docs, model).select("doc_id", "score").collect()
            assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    empty = documents(spark, [])
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, labels(spark))).count() == 0
    model = quality.fit_quality(empty, labels(spark))
    assert {r.score for r in quality.score_quality(documents(spark), model).collect()} == {0.5}


def test_mining_finds_stems():
    assert toxicity.one_per_family(["lowei*", "lowe*", "loweiab", "scum", "scu*", "zzz"], 3) == ["lowei*", "scum", "zzz"]
    features = toxicity.chosen_features(["lowei*", "idiot", "loweiab"])
    families = features.families()
    name = lambda text: {features.names[i] for i in toxicity.featurize(text, features, families)[0] if i < len(features.names)}
    assert name("Loweixyz LOWE idiots Idiot") == {"lowei*", "idiot"}
    assert name(None) == set()


def test_isotonic_against_definition():
    random = np.random.default_rng(0)
    values, target, rows = np.sort(random.random(12)), random.random(12), random.integers(1, 5, 12)
    centres, levels = linear.isotonic(values, target, rows)
    assert (np.diff(levels) > 0).all() and (np.diff(centres) > 0).all()
    # min-max formula of isotonic regression
    fit = [max(min(np.average(target[a : b + 1], weights=rows[a : b + 1]) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
    assert np.allclose(sorted(set(np.round(fit, 9))), np.round(levels, 9))


def test_random_features_approach_the_kernel():
    random = np.random.default_rng(1)
    d, waves = 5, 20_000
    model = quality.QualityModel(
        np.zeros(d), np.ones(d), random.normal(0, 1 / quality.WIDTH, (d, waves)), random.uniform(0, 2 * np.pi, waves),
        np.zeros(waves + 1), np.zeros(1), np.zeros(1),
    )
    x = random.normal(size=(6, d))
    z = model.expand(x)[:, :-1]
    gaps = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-gaps / (2 * quality.WIDTH**2))).max() < 0.05


def test_viterbi_is_the_best_marking():
    random = np.random.default_rng(3)
    for _ in range(60):
        n = random.integers(1, 9)
        x = random.integers(0, 2, (n, 4)).astype(float)
        model = line_crf.LineCrf(random.normal(size=4), float(random.random() * 1.5))

        def total(marks, x=x, model=model):
            sign = np.where(np.array(marks) == 1, 1, -1)
            return (sign * (x @ model.weights) / 2).sum() + model.link * (sign[1:] * sign[:-1]).sum()

        best = max(itertools.product((0, 1), repeat=n), key=total)
        assert total(model.decode(x)) == pytest.approx(total(best))


def plain_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(hit)


def test_rule_counts_against_definition():
    random = np.random.default_rng(4)
    model = line_crf.LineCrf(np.array(line_crf.PRIOR), 0.5)
    texts = [" ".join(random.choice(["a", "b", "c#", "d\n", "e|"], n)) for n in (0, 1, 2, 3, 5, 40, 120)] + [None, "", "x y\nx y\n \n \nx y"]
    for text in texts:
        words = (text or "").split()
        got = line_crf.judged(text, model)
        lines = [x for x in (text or "").split("\n") if x.strip()]
        assert got[:5] == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), plain_repeats(words)
        )


def test_long_lines_count_whole():
    model = line_crf.LineCrf(np.array(line_crf.PRIOR), 0.5)
    prose = "people came to the old town hall and talked about the bridge " * 34
    at = [line_crf.FEATURES.index(name) for name in ("shouting", "digits")]
    for odd, want in (("SALE NOW " * 1000, [1, 0]), ("12345678 " * 1000, [0, 1]), (prose * 5, [0, 0])):
        for line in (prose + odd, odd + prose):
            assert len(prose) > 2000 and line_crf.line_features(line)[0][0, at].tolist() == want
    for odd in ("SALE NOW " * 230, "12345678 " * 230):
        assert line_crf.line_features(odd + prose * 10)[0][0, at].tolist() == [0, 0]
    assert line_crf.judged(prose + "SALE NOW " * 1000, model)[5] == 0


def test_rules_keep_prose_and_drop_junk(spark):
    prose = "The committee met in the old town hall and talked about the new bridge over the river for hours. " * 4
    prose = "\n".join(f"{i} people came. " + prose.replace("hours", f"{i} hours") for i in range(1, 3))
    prose = " ".join(dict.fromkeys(prose.split())) + " and so on until everybody had gone home to sleep well again after such a long day at last with friends. " + " ".join(f"word{chr(97 + i)}" for i in range(20))
    junk = "\n".join(" ".join(f"w{i}{j}***" for j in range(10)) for i in range(12))
    df = documents(spark, [(1, prose, "en", "a", 1), (2, junk, "en", "a", 1), *ROWS[4:7]])
    model = line_crf.fit_line_crf(df, labels(spark))
    assert np.allclose(model.weights, line_crf.PRIOR)
    out = {r.doc_id: r for r in line_crf.apply_rules(clashing(df), model).collect()}
    assert out[1].kept and not out[2].kept and not out[2].base_failed
    assert out[4].base_failed and out[5].n_words == 0 and not out[6].kept
    assert line_crf.apply_rules(documents(spark, []), model).count() == 0


def test_clean_documents_are_kept(spark):
    out = QUERIES["op7_line_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    good = out[(out.quality == 1) & ~out.base_failed]
    assert good.kept.mean() > 0.97
    assert out[(out.quality == 0)].kept.mean() < 0.1


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
        out[ids[q]] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def test_recall_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = df.select("vec_id", "embedding").toPandas()
    ids, x = pdf.vec_id.to_numpy(), np.stack(pdf.embedding).astype(np.float64)
    got = hnsw.nearest(df.where("vec_id % 20 = 0"), hnsw.build_index(df, shard_rows=500), query_block=30).toPandas()
    want = brute(ids, x, np.flatnonzero(ids % 20 == 0), 10)
    assert set(got.query_id) == set(want)
    hits = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 11))
        assert list(zip(part.score, part.vec_id, strict=True)) == sorted(zip(part.score, part.vec_id, strict=True))
        hits += len(set(part.vec_id) & {i for i, _ in want[q]})
    assert hits / (10 * len(want)) >= 0.95


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (21, [1.0, 0.0]), (22, [0.0, 1.0]), (23, [0.0, 0.0]), (24, None), (25, [1.0, None]),
            (26, [nan, 1.0]), (27, [inf, 1.0]), (None, [1.0, 0.0]), (0, [1.0, 0.0]), (40, [5.0, 5.0, 5.0]), (60, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x")).withColumn("row", F.lit(1))
    got = hnsw.nearest(df.where("vec_id % 20 = 0"), hnsw.build_index(df), k=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 20, 0.0), (0, 2, 21, 0.0), (20, 1, 0, 0.0), (20, 2, 21, 0.0)]
    few = hnsw.nearest(df.where("vec_id = 22"), hnsw.build_index(df), k=10).orderBy("rank").collect()
    assert [r.vec_id for r in few] == [0, 20, 21]
    empty = df.limit(0)
    assert hnsw.nearest(df, hnsw.build_index(empty)).count() == 0
    assert hnsw.nearest(empty, hnsw.build_index(df)).count() == 0


def test_many_equal_vectors(spark):
    random = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else random.normal(size=3).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ids, x = np.arange(900), np.array([v for _, v in rows])
    got = hnsw.nearest(df.where("vec_id in (1, 3, 500)"), hnsw.build_index(df, shard_rows=200)).orderBy("query_id", "rank").collect()
    want = brute(ids, x, [1, 3, 500], 10)
    for q in (1, 3, 500):
        assert [r.vec_id for r in got if r.query_id == q] == [i for i, _ in want[q]]


def test_posteriors_against_loops():
    """The label model's formula, vote by vote, in plain Python."""
    r = np.random.default_rng(3)
    n = 6
    rates = np.stack([r.uniform(0.01, 0.1, n), r.uniform(0.2, 0.8, n)])
    c = np.eye(n)
    c[0, 1] = c[1, 0] = 0.7
    c[2, 3] = c[3, 2] = -0.4
    model = toxicity.LabelModel(0.1, rates, c)
    votes = np.arange(64)
    for vote, got in zip(votes.tolist(), model.posterior(votes), strict=True):
        on = [bool(vote >> i & 1) for i in range(n)]
        logit = math.log(0.1 / 0.9)
        for i in range(n):
            like = sum(max(c[i, j], 0) for j in range(n) if on[j] == on[i])
            odds = rates[1, i] / rates[0, i] if on[i] else (1 - rates[1, i]) / (1 - rates[0, i])
            logit += math.log(odds) / max(like, 1)
        assert got == pytest.approx(1 / (1 + math.exp(-logit)))


def test_weighted_sums_and_newton_against_numpy(spark):
    """Sums over patterns, and the classifier on 200 rows, against dense arrays on the driver."""
    r = np.random.default_rng(4)
    n = 5
    model = toxicity.LabelModel(0.2, np.stack([np.full(n, 0.05), np.full(n, 0.5)]), np.eye(n))
    rows = [(int(v), None if k % 3 else int(v % 2), int(w)) for k, (v, w) in enumerate(zip(r.integers(0, 32, 60), r.integers(1, 9, 60), strict=True))]
    patterns = spark.createDataFrame(rows, "votes long, toxic int, rows long").repartition(3)
    mass, products = toxicity.weighted_sums(patterns, model)
    votes, weight = np.array([x[0] for x in rows]), np.array([x[2] for x in rows], float)
    p = np.array([q if y is None else y for q, (_, y, _) in zip(model.posterior(votes), rows, strict=True)])
    v = (votes[:, None] >> np.arange(n)) & 1
    for c, share in ((0, 1 - p), (1, p)):
        assert mass[c] == pytest.approx((share * weight).sum())
        assert np.allclose(products[c], (v * (share * weight)[:, None]).T @ v)

    hits = [(sorted(r.choice(7, r.integers(0, 4), replace=False).tolist()), int(r.integers(0, 32)), int(r.integers(1, 4))) for _ in range(200)]
    table = spark.createDataFrame(hits, "hits array<int>, votes long, rows long").repartition(3)
    w, bias = toxicity.fit_linear(table, model, 7)
    x = np.array([[float(i in h) for i in range(7)] + [1.0] for h, _, _ in hits])
    y, rows_ = model.posterior(np.array([h[1] for h in hits])), np.array([h[2] for h in hits], float)
    ridge = np.array([1.0] * 7 + [1e-6])
    dense = np.zeros(8)
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ dense))
        dense -= np.linalg.solve((x * (rows_ * q * (1 - q))[:, None]).T @ x + np.diag(ridge), x.T @ (rows_ * (q - y)) + ridge * dense)
    assert np.allclose(np.append(w, bias), dense, atol=1e-4)


def test_ridge_against_numpy(spark):
    """Normal equations summed by partition, against one dense system over 200 documents."""
    random.seed(8)
    rows = [(i, " ".join(random.choices(["good", "words", "and", "more", "!!!", "BUY"], k=random.randrange(1, 60))), None, None, None) for i in range(200)]
    known = [(i, int("!!!" not in t), 0) for i, t, *_ in rows]
    docs = documents(spark, rows).repartition(5)
    model = quality.fit_quality(docs, labels(spark, known), held_out=99)
    z = model.expand(np.stack([quality.statistics(t) for _, t, *_ in rows]))
    shrink = np.diag(np.append(np.full(quality.WAVES, quality.RIDGE), 1e-6))
    y = np.array([q for _, q, _ in known], float)
    solved = lambda rows: np.linalg.solve(z[rows].T @ z[rows] + shrink, z[rows].T @ y[rows])
    assert np.allclose(z @ model.weights, z @ solved(np.arange(200)), atol=1e-6)
    # The calibration sees each half through the ridge of the other one.
    half = np.array([r.h for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id), 2) h").orderBy("doc_id").collect()])
    halves = [np.flatnonzero(half == h) for h in (0, 1)]
    ridge = np.zeros(200)
    for seen, other in (halves, halves[::-1]):
        ridge[other] = z[other] @ solved(seen)
    s = np.clip(ridge, -0.5, 1.5)
    at = np.minimum(((s + 0.5) / 2 * quality.BINS).astype(int), quality.BINS - 1)
    used = np.unique(at)
    n = np.array([(at == b).sum() for b in used])
    centres, levels = linear.isotonic(
        np.array([s[at == b].mean() for b in used]), np.array([y[at == b].mean() for b in used]), n
    )
    assert np.allclose(model.calibrated(s), np.clip(np.interp(s, centres, levels), 0, 1), atol=1e-4)


def test_rejection_threshold_keeps_clean_documents(spark):
    texts = ["you pathetic worthless idiot", "a lovely walk by the river"] * 40
    docs = documents(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    known = labels(spark, [(i, 1, int(i % 2 == 0)) for i in range(80)])
    model = toxicity.fit_toxicity(docs, known)
    assert toxicity.rejection_threshold(docs, known, model) == 0.5  # 40 clean documents cannot tell 1 in 200
    t = toxicity.rejection_threshold(docs, known, model, lost=0.05)
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert 0.05 <= t < 0.5 and sum(scores[i] >= t for i in range(1, 80, 2)) == 0
    assert toxicity.rejection_threshold(docs, labels(spark), model) == 0.5


def test_rejection_threshold_hears_all_labelled_documents(spark):
    """Clean documents that look toxic, all of them behind the first 20000 labelled ones by a hash of the id."""
    ids = spark.range(20_600).withColumnRenamed("id", "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id")
    late = [r.doc_id for r in ids.offset(20_000).collect()]
    texts = ["you pathetic worthless idiot", "a lovely walk by the river"] * 40
    docs = documents(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    model = toxicity.fit_toxicity(docs, labels(spark, [(i, 1, int(i % 2 == 0)) for i in range(80)]))
    shown = F.when(F.col("doc_id").isin(late), texts[0]).otherwise(texts[1])
    many = spark.range(20_600).select(F.col("id").alias("doc_id"), F.lit(0).alias("toxic"))
    assert toxicity.rejection_threshold(many.withColumn("text", shown), many, model) == 0.5
    assert toxicity.rejection_threshold(many.withColumn("text", F.lit(texts[1])), many, model) < 0.5


def test_lines_are_counted_alike_in_ascii_and_beyond():
    """A line's features with a letter that is not ASCII beside those without, and notices in odd letters."""
    line = "SIGN UP| now 12# $money$ !"
    plain, beyond = (line_crf.line_features(t)[0][0] for t in (line, line.replace("now", "nów")))
    assert plain.tolist() == beyond.tolist()
    notice = line_crf.FEATURES.index("notice")
    for text in ("ſign up", "cooKie", "Log in", "LOGIN", "log\tin", "HTTPS://x", "Licence", "(C) me", "WWW.x"):
        assert line_crf.line_features(text)[0][0, notice] == (line_crf.NOTICE.search(text) is not None)
    # Signs that Python strips and the contract does not: they are words, as ever.
    assert line_crf.judged("\xa0\na\x1cb c", line_crf.LineCrf(np.array(line_crf.PRIOR), 0.5))[:2] == (3, 5)
