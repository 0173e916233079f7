"""Line dedup: range-partitioned line hashes, first occurrences and keep bitmaps; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import KEY, SPACE, keyed, shuffle_partitions
from granary.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """Lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def line_runs(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """One row per line with a key, in runs sorted by hash, document and position.

    The hash has 128 bits. Runs are cut by range over (hash, salt of the document): a line that a
    third of all documents hold spreads over as many ranges as there are partitions. ``opens`` marks
    the first line of a document within its run, ``leads`` the first line of the run.
    """
    n = shuffle_partitions(docs.sparkSession)
    key = line_key(F.col("line"))
    # Written first: the bounds of the ranges come from a sample, which would read the texts once more.
    lines = written(
        keyed(docs.select("doc_id", "text"))
        .select(*KEY, F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .withColumn("key", key)
        .where(F.length("key") >= min_chars)
        .select(*KEY, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))
        .withColumn("salt", F.pmod(F.xxhash64(*KEY), F.lit(n))),
        "lines",
    )
    run = ["h1", "h2", "salt"]
    along = Window.partitionBy(*run).orderBy(*KEY, "pos")
    document = F.struct(*KEY)
    return (
        lines.repartitionByRange(n, *run)
        .sortWithinPartitions(*run, *KEY, "pos")
        .withColumn("opens", F.coalesce(F.lag(document).over(along) != document, F.lit(True)))
        .withColumn("leads", F.row_number().over(along) == 1)
    )


def keep_bitmaps(docs: DataFrame, min_docs: int = 2, keep_first: bool = True, min_chars: int = 1) -> DataFrame:
    """Keep bitmaps of the documents that lose lines: key columns, ``keep`` and ``n_dropped``.

    A key of at least ``min_chars`` code points that ``min_docs`` documents hold loses all its lines,
    or with ``keep_first`` all but the first one by (id, text hash, position). ``keep`` is compressed: only
    the words that drop a line are in it, as (gap, bits), with the number of words left out before each; bit
    ``i % 64`` of word ``i // 64`` tells whether line i stays. Lines of words left out stay, and documents
    without a row keep all. Null and empty texts, and tables without rows, give no row. Other columns are
    not read.
    """
    runs = written(line_runs(docs, min_chars), "line-runs")
    place = F.struct(*KEY, "pos")
    # Written, so that both sides of the join below are shuffled for it alone: Spark can then split
    # the partition of a line that very many documents hold.
    frequent = written(
        runs.groupBy("h1", "h2")
        .agg(
            F.sum(F.col("opens").cast("long")).alias("n_docs"),
            F.min(F.when(F.col("leads"), place)).alias("first"),
        )
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "first"),
        "frequent-lines",
    )
    dropped = runs.select("h1", "h2", *KEY, "pos").join(frequent, ["h1", "h2"])
    if keep_first:
        dropped = dropped.where(place != F.col("first"))
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    words = (
        dropped.withColumn("word", F.expr("cast(pos div 64 as int)"))
        .groupBy(*KEY, "word")
        .agg(F.bit_or(bit).alias("bits"))
    )
    along = Window.partitionBy(*KEY).orderBy("word")
    gap = F.col("word") - F.coalesce(F.lag("word").over(along), F.lit(-1)) - 1
    packed = F.sort_array(F.collect_list(F.struct("word", "gap", "bits")))
    return (
        words.withColumn("gap", gap)
        .groupBy(*KEY)
        .agg(packed.alias("packed"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"))
        .select(
            *KEY,
            F.transform("packed", lambda w: F.struct(w["gap"].alias("gap"), F.bitwise_not(w["bits"]).alias("bits"))).alias("keep"),
            "n_dropped",
        )
    )


def unpacked(keep: Column) -> Column:
    """All words of a compressed bitmap up to its last one."""
    full = F.lit(-1).cast("long")
    return F.flatten(F.transform(keep, lambda w: F.concat(F.array_repeat(full, w["gap"]), F.array(w["bits"]))))


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines whose bit is set, or that lie beyond the bitmap."""
    flags = F.flatten(
        F.transform(unpacked(keep), lambda word: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(word, i) == 1))
    )
    both = F.arrays_zip(lines.alias("line"), F.coalesce(flags, F.array().cast("array<boolean>")).alias("stays"))
    both = F.filter(both, lambda z: z["line"].isNotNull() & F.coalesce(z["stays"], F.lit(True)))
    return F.transform(both, lambda z: z["line"])


def dedup_lines(docs: DataFrame, min_docs: int = 2, keep_first: bool = True, min_chars: int = 1) -> DataFrame:
    """``docs`` with the text that stays, ``n_lines`` (before) and ``n_dropped`` as ``_n_lines``, ``_n_dropped``.

    Other columns pass through, repeated rows stay repeated. A document that loses nothing keeps its
    text as it is, null included; one that loses every line has an empty text.
    """
    bitmaps = keep_bitmaps(docs, min_docs, keep_first, min_chars)
    lines = lines_of(F.col("text"))
    return (
        keyed(docs)
        .join(bitmaps.withColumnsRenamed({"keep": "_keep", "n_dropped": "_dropped"}), KEY, "left")
        .withColumns(
            {
                "_n_lines": F.size(lines).cast("long"),
                "_n_dropped": F.coalesce("_dropped", F.lit(0)).cast("long"),
                "text": F.when(F.col("_keep").isNull(), F.col("text")).otherwise(
                    F.array_join(kept_lines(lines, F.col("_keep")), "\n")
                ),
            }
        )
        .drop(*KEY, "_keep", "_dropped")
    )
