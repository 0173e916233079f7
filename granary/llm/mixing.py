"""Mixing sources to target weights: fixed-length blocks, per-shard draws, index permutations; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import running_start, shuffle_partitions, word_count
from granary.session import written

BLOCK_WORDS = 64
SHARD_BLOCKS = 4096
#: A source gives at most so many times its own size.
MOST_REPEATS = 3
DRAWS_PER_ROW = 16_384
ROUNDS = 16
#: Parts of a document that its fraction is counted in.
PARTS = 1_000_000


def permuted(x: Column, n: Column, *seed: Column) -> Column:
    """Pseudorandom bijection of 0..n-1, exact for every n (rounds of swap-or-not)."""

    def swap(at: Column, round_: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*seed, round_), n) - at, n)
        coin = F.pmod(F.xxhash64(F.greatest(at, mirror), round_, *seed), F.lit(2)) == 1
        return F.when(coin, mirror).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, swap)


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and a row number, as a written table."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tag"))
    return written(sized.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source: ``source``, ``rank`` (from 0), ``weight``, ``source_size``, ``target``.

    Sources in code point order, null last, weigh 1, 2, 3, repeating, and share the total of all
    sizes. A target stops at three times its source; what is over goes to the others by weight. With
    the sources ordered by size per weight the stopped ones come first, so that one running total
    finds the share per weight that is left. Sources, not documents, pass these windows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", (F.row_number().over(by_name) - 1).cast("long"))
        .withColumn("weight", F.col("rank") % 3 + 1)
        .withColumn("most", F.col("source_size") * MOST_REPEATS)
    )
    by_fill = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_fill.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0))
    sources = sources.withColumn("share", left / F.sum("weight").over(onwards))
    open_ = F.col("most") >= F.col("weight") * F.col("share")
    order = F.struct(F.col("most") / F.col("weight"), F.col("rank"))
    share = F.min(F.when(open_, F.struct(order.alias("order"), F.col("share")))).over(Window.partitionBy())["share"]
    return sources.select(
        "source", "rank", "weight", "source_size",
        F.least(F.col("most").cast("double"), F.col("weight") * share).alias("target"),
    )


def block_draws(sources: DataFrame, block_words: int, shard_blocks: int, seed: int) -> DataFrame:
    """One row per output slot: ``shard``, ``slot``, ``rank`` of the source and ``block``.

    Each source gives as many blocks as its target holds. The slots of all shards are dealt through
    one permutation, so the counts of the sources in a shard are a multinomial draw under the
    condition that all shards together meet the targets. Draw k of a source of n blocks takes block
    ``permutation(k mod n)`` of round ``k div n``.
    """
    n_blocks = F.ceil(F.col("source_size") / block_words)
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    quota = F.least(
        F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long"), F.col("n_blocks") * MOST_REPEATS
    )
    plan = (
        sources.where(F.col("source_size") > 0)
        .withColumn("n_blocks", n_blocks)
        .withColumn("quota", quota)
        .withColumn("base", F.coalesce(F.sum("quota").over(before), F.lit(0)))
        .withColumn("slots", F.sum("quota").over(Window.partitionBy()))
        .where(F.col("quota") > 0)
    )
    # Two steps, so that no row holds all draws of a source; by number, so that Spark leaves the parts apart.
    chunks = plan.select(
        "rank", "n_blocks", "base", "slots", "quota",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1, F.lit(DRAWS_PER_ROW).cast("long"))).alias("from"),
    ).repartition(shuffle_partitions(sources.sparkSession), "rank", "from")
    last = F.least(F.col("from") + DRAWS_PER_ROW, F.col("quota")) - 1
    draws = chunks.select("rank", "n_blocks", "base", "slots", F.explode(F.sequence("from", last)).alias("draw"))
    at = permuted(F.col("base") + F.col("draw"), F.col("slots"), F.lit(seed))
    turn = F.expr("draw div n_blocks")
    block = permuted(F.col("draw") % F.col("n_blocks"), F.col("n_blocks"), F.lit(seed), F.col("rank"), turn)
    return draws.select("rank", at.alias("at"), block.alias("block")).select(
        F.expr(f"at div {shard_blocks}").alias("shard"), (F.col("at") % shard_blocks).alias("slot"), "rank", "block"
    )


def document_pieces(sized: DataFrame, sources: DataFrame, block_words: int) -> DataFrame:
    """The piece of each document in each block of its source: row, rank, block, from, words.

    A source's documents are laid end to end in the order of a hash, so no document and no block
    needs more than its own rows; only counts move, never texts.
    """
    ranks = sources.select("source", "rank")
    placed = sized.where("size > 0").join(ranks, sized["source"].eqNullSafe(ranks["source"])).drop(ranks["source"])
    n = sized.count()
    parts = max(1, round(n**0.5))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "tag"), F.lit(parts)))
    placed = placed.select("row", "rank", "size", "part", "doc_id", "tag")
    placed = running_start(placed, ["rank"], "part", ["doc_id", "tag", "row"], "size", "start")
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    pieces = placed.withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return pieces.select("row", "rank", "block", (low - F.col("start")).alias("from"), (high - low).alias("words"))


def mix(
    docs: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 20
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized documents, targets, plan). The plan has a row per slot and piece: shard, slot, row, from, words.

    Reads doc_id, source and text only, whatever other columns there are. A null text has no words, a
    null source is a source of its own, null ids are ids like others, repeated rows are documents of
    their own. A table without rows, or without words, gives an empty plan. The plan depends on ids,
    texts, sources and the seed alone, so reruns agree.
    """
    sized = sized_documents(docs)
    sources = written(source_targets(sized), "mix-targets")
    draws = block_draws(sources, block_words, shard_blocks, seed)
    pieces = document_pieces(sized, sources, block_words)
    # Both sides grow with the corpus, whatever Spark takes them for before the draws are unfolded.
    plan = draws.hint("merge").join(pieces, ["rank", "block"]).select("shard", "slot", "row", "from", "words")
    return sized, sources, plan


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target and ``taken``, the words that the mix takes of it."""
    sized, sources, plan = mix(docs, **options)
    taken = plan.groupBy("row").agg(F.sum("words").alias("taken"))
    known = sources.select(F.col("source").alias("_source"), "source_size", "target")
    return (
        sized.join(known, sized["source"].eqNullSafe(known["_source"]))
        .join(taken, "row", "left")
        .select(
            "doc_id", "size", "source", "source_size", "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "tag",
        )
    )


def document_copies(docs: DataFrame, **options) -> DataFrame:
    """How often the mix takes each document as a whole: doc_id, source, ``tag`` (hash of the text), ``copies``.

    The plan takes a document's words some times over on average, a number with a fraction. Its whole part
    is taken as it is; the fractions are summed up along the documents of a source from the largest class of
    sizes to the smallest, and a document is taken once more where the running sum passes a whole number. So
    a source's words differ from its target by about one document of each class at most. A document is
    taken 0 to 3 times, without a word not at all. Repeated rows share their copies evenly, rounded up from
    a half.
    """
    sized, _, plan = mix(docs, **options)
    taken = plan.groupBy("row").agg(F.sum("words").alias("taken"))
    known = sized.where("size > 0").join(taken, "row", "left")
    share = F.coalesce("taken", F.lit(0)) / F.col("size")
    known = known.withColumns({"whole": F.floor(share).cast("long"), "rest": F.round((share - F.floor(share)) * PARTS).cast("long")})
    # Sums of whole millionths, in parts of a class: the same in every run.
    parts = max(1, round(sized.count() ** 0.5))
    part = (63 - F.floor(F.log2(F.col("size")))) * parts + F.pmod(F.xxhash64("doc_id", "tag"), F.lit(parts))
    known = known.withColumns({"part": part.cast("long"), "no_source": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))})
    placed = written(known, "document-shares")
    placed = running_start(placed, ["no_source", "_source"], "part", ["doc_id", "tag", "row"], "rest", "_until")
    half = PARTS // 2
    once_more = F.expr(f"(_until + rest + {half}) div {PARTS} - (_until + {half}) div {PARTS}")
    copies = placed.select("row", (F.col("whole") + once_more).alias("copies"))
    return (
        sized.join(copies, "row", "left")
        .groupBy("doc_id", "source", "tag")
        .agg(F.round(F.avg(F.coalesce("copies", F.lit(0)))).cast("int").alias("copies"))
    )
