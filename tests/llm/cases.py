"""Small tables with the odd cases that every operator has to take."""

from __future__ import annotations

PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree by the river"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ROWS = [
    (1, PROSE, "en", "a", 100),
    (2, PROSE, "en", "b", 100),
    (2, PROSE, "en", "b", 100),  # repeated row
    (3, PROSE + " bank", None, None, None),
    (4, None, "en", "a", 0),
    (5, "", "en", None, 0),
    (6, " \n\t \n", "de", "c", 5),
    (None, "one line\nanother line\none line", "en", "a", 30),
    (None, None, None, None, None),
    (7, "you pathetic idiot, you worthless scum\n" * 3, "en", "b", 117),
    (8, "word " * 30_000, "en", "a", 150_000),
    (9, "x" * 60_000, "en", "c", 60_000),
    (10, "é中🙂 naïve text\x85 with\todd\x0bspaces", "fr", "d", 30),
]

#: Columns that an operator may use inside or add.
CLASHING = (
    "score ids size taken target row rank block pos line key word keep tag copies n_links class_id print votes hits "
    "_k_id _k_null _k_text _text _ids _keep _n_lines _n_dropped _dropped _source _again part start c0 t n_tokens"
).split()


def documents(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(name) for i, name in enumerate(CLASHING)])


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
