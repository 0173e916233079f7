"""Values that must come through Python unharmed: large integers beside nulls, in every type."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from granary.llm import bpe, line_crf, quality, toxicity
from tests.llm.cases import PROSE, documents, labels

IDS = [2**53 + 1, 2**60 + 1, None, -(2**62) - 1, 0]
ROWS = [(i, PROSE + f" number {k}", "en", "a", i) for k, i in enumerate(IDS)]


def ids_of(df, name="doc_id"):
    key = lambda i: (i is None, i or 0)
    return sorted((r[name] for r in df.coalesce(1).collect()), key=key)


WANT = sorted(IDS, key=lambda i: (i is None, i or 0))


def one_batch(spark, rows=ROWS):
    return documents(spark, rows).coalesce(1)


def test_line_rules_keep_ids(spark):
    out = line_crf.apply_rules(one_batch(spark), line_crf.fit_line_crf(one_batch(spark), labels(spark)))
    assert ids_of(out) == WANT


def test_line_rules_odd_rows(spark):
    """Repeated rows, a null id, and a whole very long text."""
    long = "word after word goes on and on .\n" * 40_000
    rows = [(1, long, "en", "a", 1), (1, long, "en", "a", 1), (None, PROSE, "en", "a", 1), (2, None, "en", "a", 1)]
    model = line_crf.fit_line_crf(documents(spark, []), labels(spark))
    got = line_crf.apply_rules(documents(spark, rows), model).collect()
    assert sorted((r.n_words, r.n_dup_lines) for r in got) == [(0, 0), (len(PROSE.split()), 0), (320_000, 39_999), (320_000, 39_999)]
    assert line_crf.apply_rules(documents(spark, []), model).count() == 0


def test_bpe_keeps_every_column(spark):
    schema = (
        "doc_id long, text string, small short, price decimal(30,5), day date, at timestamp, flag boolean, "
        "list array<long>, map map<string,long>, part struct<a:long,b:string>, bytes binary, real float"
    )
    full = (2**60 + 1, "some text", 7, Decimal("12345678901234567890.12345"), date(1, 1, 1), datetime(2020, 1, 2, 3, 4, 5, 678901),
            True, [2**60 + 1, None], {"k": 2**60 + 1}, (2**60 + 1, None), bytearray(b"\x00\xff"), 0.1)
    rows = [full, (None, "x", *[None] * 10), (2**53 + 1, None, *full[2:])]
    df = spark.createDataFrame(rows, schema).coalesce(1)
    out = bpe.encode_documents(df, out="ids", checked="same").drop("ids", "same")
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    assert out.columns == [c for c in df.columns if c != "text"]
    assert sorted(out.collect(), key=key) == sorted(df.drop("text").collect(), key=key)


def test_toxicity_labels_reach_large_ids(spark):
    """Ids beside a null id keep their labels: the same ids below 2**53 give the same model."""
    texts = ["you pathetic worthless idiot", "a lovely walk by the river"] * 20
    known = lambda ids: labels(spark, [(i, 1, int(k % 2 == 0)) for k, i in enumerate(ids)])
    large = [2**60 + 2 * k + 1 for k in range(40)]
    rows = lambda ids, own: documents(spark, [(i, t, None, None, None) for i, t in zip([*ids, own], [*texts, "x"], strict=True)])
    score = lambda ids, own: toxicity.fit_toxicity(rows(ids, own).coalesce(1), known(ids), held_out=9)
    a, b = score(large, None), score(large, 5)
    assert abs(a.bias - b.bias) < 1e-9 and abs(a.weights - b.weights).max() < 1e-9


def test_quality_scores_beside_large_ids(spark):
    model = quality.fit_quality(one_batch(spark), labels(spark, [(2**60 + 1, 1, 0), (2**53 + 1, 0, 0)]), held_out=9)
    assert ids_of(quality.score_quality(one_batch(spark), model)) == WANT
