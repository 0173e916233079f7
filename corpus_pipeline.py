"""The corpus pipeline: from documents to token ids, in stages that are written and read again.

Stages: toxic documents go; lines that many documents hold stay in one of them; of near copies one
document stays; sources are mixed to target weights; texts become token ids. Every stage handles
nulls, empty texts, repeated rows and tables without rows as its operator states, and passes
columns beyond those of ``documents`` through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.bpe import encode_documents
from granary.llm.common import KEY, keyed, table
from granary.llm.line_dedup import dedup_lines
from granary.llm.mixing import document_copies
from granary.llm.ngram_join import one_per_class
from granary.llm.queries import BATCH_DOCUMENTS
from granary.llm.toxicity import fit_toxicity, rejection_threshold, score_toxicity
from granary.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LINE_DOCUMENTS = 10


def own_names(docs: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` with columns beyond ``COLUMNS`` under names that cannot meet those of an operator.

    A column that the step adds replaces one of the same name. Documents go to Python in batches that
    stay small beside an executor's memory.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_DOCUMENTS))
    extra = {c: f"extra_{i}" for i, c in enumerate(c for c in docs.columns if c not in COLUMNS)}
    plain = docs.select(*[F.col(f"`{c}`").alias(extra.get(c, c)) for c in docs.columns])
    out = step(plain)
    back = {v: k for k, v in extra.items()}
    return out.select(*[F.col(c).alias(back.get(c, c)) for c in out.columns if back.get(c) not in out.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below a threshold; the model learns from the labels of ``sf_dir``.

    The threshold is the least from which on at most one in 200 of the documents labelled clean lies, and at most 0.5.
    """
    labels = table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels)
    threshold = rejection_threshold(docs, labels, model)
    keep = lambda d: score_toxicity(d, model).where(F.col("score") < threshold).drop("score")
    return own_names(docs, keep)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; a line that ``LINE_DOCUMENTS`` documents hold stays where it comes first. ``n_chars`` follows."""

    def step(plain: DataFrame) -> DataFrame:
        out = dedup_lines(plain, min_docs=LINE_DOCUMENTS, keep_first=True)
        length = F.when(F.col("_n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        return out.withColumn("n_chars", length).select(*plain.columns)

    return own_names(docs, step)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one of the smallest id; texts without words all stay."""
    return own_names(docs, lambda plain: one_per_class(plain).select(*plain.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 3 times), fractions carried on along its source."""

    def step(plain: DataFrame) -> DataFrame:
        taken = document_copies(plain).where("copies > 0").select(
            F.col("doc_id").isNull().alias(KEY[0]),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(KEY[1]),
            F.col("tag").alias(KEY[2]),
            F.col("source").isNull().alias("_no_source"),
            F.coalesce("source", F.lit("")).alias("_source"),
            F.array_repeat(F.lit(True), F.col("copies")).alias("_copies"),
        )
        own = keyed(plain).withColumns(
            {"_no_source": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))}
        )
        return own.join(taken, [*KEY, "_no_source", "_source"]).select(*plain.columns, F.explode("_copies")).drop("col")

    return own_names(docs, step)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the text: its token ids (little-endian unsigned 32-bit), their number, and whether they decode to it."""

    def step(plain: DataFrame) -> DataFrame:
        out = encode_documents(plain, out="ids", checked="decodes")
        return out.withColumn("n_tokens", F.expr("cast(octet_length(ids) div 4 as bigint)"))

    return own_names(docs, step)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", near_duplicates),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: SQL can express neither the label model nor the token ids.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
