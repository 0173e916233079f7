"""Deterministic splits and samples. No result depends on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.scalars import half_even, key_hash, unit_interval
from granary.operators.schema import LABEL, SOURCE
from granary.plans.ranks import add_rank, hash_quota_thresholds, within_threshold
from granary.plans.small import join_same_keys, small_side

TRAIN, TEST = "train", "test"

# Share of rows that go to train, sampling share, holdouts, seed.
TRAIN_RATIO = 0.6
SAMPLE_SHARE = 0.5
HOLDOUTS = 5
SEED = 42
# Held-out share, in general and for decision trees.
TEST_SHARE, TREE_TEST_SHARE = 0.2, 0.3


def goes_to_train(rank: Column, ratio: float) -> Column:
    """Whether a group's ``rank``-th row (from 1) is a train row.

    Walking a group in order and topping train up to ``round(n * ratio)`` sends
    row n to train exactly when that rounded target grows at n.
    """
    n = rank.cast("double")
    return half_even(n * F.lit(float(ratio))) > half_even((n - 1) * F.lit(float(ratio)))


def ratio_split(
    df: DataFrame,
    order: list[str],
    ratio: float = TRAIN_RATIO,
    by: tuple[str, ...] = (SOURCE, LABEL),
    slices: list[str] | None = None,
    out: str = "split",
) -> DataFrame:
    """Train/test split in row order per group, exact to half a row per group.

    ``order`` must be a unique key of the rows. Hot groups are cut into slices
    (see ``add_rank``), so that no task sorts a whole group.
    """
    ranked = add_rank(df, list(by), order, "__rank", slices)
    side = F.when(goes_to_train(F.col("__rank"), ratio), TRAIN).otherwise(TEST)
    return ranked.withColumn(out, side).drop("__rank")


def random_split(
    df: DataFrame, key: str, ratio: float = TRAIN_RATIO, seed: int = SEED, out: str = "split"
) -> DataFrame:
    """Bernoulli split by a hash of the key, for tables without a label."""
    draw = unit_interval(key_hash(key, seed))
    return df.withColumn(out, F.when(draw < F.lit(float(ratio)), TRAIN).otherwise(TEST))


def split_summary(df: DataFrame, source_column: str = SOURCE, split: str = "split") -> DataFrame:
    """Train and test rows per source, plus one total row with a NULL source."""
    return df.rollup(source_column).agg(
        F.count_if(F.col(split) == TRAIN).alias("train_rows"),
        F.count_if(F.col(split) == TEST).alias("test_rows"),
        F.count(F.lit(1)).alias("rows"),
    )


def label_distribution(df: DataFrame, label: str = LABEL, split: str = "split") -> DataFrame:
    """Rows per label and split, with subtotals per label and a grand total (NULL keys)."""
    return df.rollup(label, split).agg(F.count(F.lit(1)).alias("rows"))


def stratified_sample(
    df: DataFrame, key: str, label: str = LABEL, share: float = SAMPLE_SHARE, seed: int = SEED
) -> DataFrame:
    """``floor(n * share)`` rows of every label, chosen by a hash of the unique key.

    Two column-pruned passes find, per label, the hash at which the quota ends;
    the rows are then filtered where they lie.
    """
    keyed = df.withColumn("__hash", key_hash(key, seed))
    order = ["__hash", key]
    limits = hash_quota_thresholds(keyed, [label], *order, lambda n: F.floor(n * F.lit(float(share))))
    joined = join_same_keys(keyed, small_side(limits), [label], "left")
    return joined.where(within_threshold(order)).drop("threshold", "__hash")


def repeated_stratified_holdout(
    df: DataFrame,
    key: str,
    label: str = LABEL,
    k: int = HOLDOUTS,
    test: float = TEST_SHARE,
    seed: int = SEED,
    prefix: str = "test_",
) -> DataFrame:
    """Add ``k`` boolean columns: is the row held out in holdout i?

    The holdouts are independent; each takes ``rint(n * test)`` rows of every
    label. A label too small for that keeps all its rows in train.
    """

    def hashed(i: int) -> Column:
        return key_hash(key, seed + i)

    draws = df.select(
        label,
        key,
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("holdout"), hashed(i).alias("hash")) for i in range(k)])
        ).alias("d"),
    ).select(
        label,
        key,
        F.col("d.holdout").alias("__holdout"),
        F.col("d.hash").alias("__hash"),
    )
    limits = hash_quota_thresholds(
        draws, ["__holdout", label], "__hash", key, lambda n: half_even(n * F.lit(float(test)))
    )
    # At most k entries per label.
    per_label = limits.groupBy(label).agg(
        F.map_from_entries(F.collect_list(F.struct("__holdout", "threshold"))).alias("__limits")
    )
    joined = join_same_keys(df, small_side(per_label), [label], "left")
    flags = [
        F.coalesce(
            F.struct(hashed(i).alias("__hash"), F.col(key)) <= F.try_element_at("__limits", F.lit(i)),
            F.lit(False),
        ).alias(f"{prefix}{i}")
        for i in range(k)
    ]
    return joined.select(*[F.col(c) for c in df.columns], *flags)
