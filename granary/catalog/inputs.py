"""Relations that Spark derives from the given tables, and the same as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import INTERMEDIATES, shared_dir


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def unsigned_zero(c: Column) -> Column:
    return F.when(c == 0, F.lit(0.0)).otherwise(c)


_EXPORTS: dict[tuple[str, str], str] = {}


def csv_export(spark: SparkSession, sf: str) -> str:
    """Customer, supplier and part as CSV folders with differing headers; written once.

    Customer's segment becomes a label column with blanks around its name.
    """
    key = (spark.sparkContext.applicationId, sf)
    if _EXPORTS.get(key) not in INTERMEDIATES:
        root = shared_dir(spark, "csv")
        frames = {
            "customer": table(spark, sf, "customer").withColumnRenamed("c_mktsegment", " label "),
            "supplier": table(spark, sf, "supplier").withColumnRenamed("s_name", "LABEL"),
            "part": table(spark, sf, "part"),
        }
        for name, df in frames.items():
            df.write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option(
                "ignoreTrailingWhiteSpace", "false"
            ).csv(f"{root}/{name}")
        _EXPORTS[key] = root
    return _EXPORTS[key]


def folder_of(c: Column | str) -> Column:
    return F.element_at(F.split(F.col(c) if isinstance(c, str) else c, "/"), -2)


INF = float("inf")


def dirty_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with infinities, NaN, NULL and missing labels by line number."""
    line = F.col("l_linenumber")
    price = (
        F.when(line == 1, F.lit(INF))
        .when(line == 2, F.lit(-INF))
        .when(line == 3, F.lit(float("nan")))
        .when(line == 4, F.lit(None).cast("double"))
        .otherwise(F.col("l_extendedprice") * 100)
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        line,
        "l_quantity",
        price.alias("price"),
        F.col("l_tax"),
        F.when(line != 7, F.col("l_returnflag")).alias(" Label "),
    )


DIRTY = """dirty as (
  select l_orderkey, l_partkey, l_linenumber, l_quantity,
    case l_linenumber when 1 then 'inf'::double when 2 then '-inf'::double
      when 3 then 'nan'::double when 4 then null else l_extendedprice * 100 end as price,
    l_tax, case when l_linenumber <> 7 then l_returnflag end as label
  from lineitem)"""

FINITE_PRICE = "case when isnan(price) or isinf(price) then null else price end"


def trial_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Holdout scores of trials: one experiment per supplier, one model per return flag,
    one combination per line number. Sums of whole quantities are exact in any order."""
    flag = F.col("l_returnflag")
    model = (
        F.when(flag == "A", "Logistic Regression").when(flag == "N", "Naive Bayes").otherwise("Other Model")
    )
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("experiment_id"),
        F.when(flag == "A", 1).when(flag == "N", 2).otherwise(3).cast("bigint").alias("model_idx"),
        model.alias("model"),
        F.col("l_linenumber").cast("bigint").alias("combo_idx"),
        F.col("l_quantity").alias("f1"),
    )


RUNS = """runs as (
  select l_suppkey as experiment_id,
    case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end as model_idx,
    case l_returnflag when 'A' then 'Logistic Regression' when 'N' then 'Naive Bayes'
      else 'Other Model' end as model,
    l_linenumber::bigint as combo_idx, l_quantity as f1
  from lineitem)"""

KEYS = ("experiment_id",)


def trials(spark: SparkSession, sf: str) -> DataFrame:
    """Mean score per trial, scaled to 0..1, with parameters made from the combination."""
    means = trial_runs(spark, sf).groupBy("experiment_id", "model_idx", "model", "combo_idx").agg(
        (F.avg("f1") / 50.0).alias("f1")
    )
    combo = F.col("combo_idx")
    params = F.create_map(
        F.lit("C"), (combo % 3).cast("string"), F.lit("max_iter"), (1000 * (combo % 2 + 1)).cast("string")
    )
    return means.withColumn("params", params)


TRIALS = RUNS + """, trials as (
  select experiment_id, model_idx, model, combo_idx, avg(f1) / 50.0 as f1,
    combo_idx % 3 as p_c, 1000 * (combo_idx % 2 + 1) as p_iter
  from runs group by all)"""

BEST = """best as (
  select experiment_id, model, combo_idx, p_c, p_iter, f1 as f1_score from trials
  qualify row_number() over (partition by experiment_id, model order by f1 desc, combo_idx) = 1)"""


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Events as samples of runs: one run per event type."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("run_id"),
        "ts",
        F.col("event_id").alias("seq"),
        (1 + F.col("user_id") % 12).cast("bigint").alias("num_workers"),
        (50000 + F.col("event_id") % 15 * 50000).cast("bigint").alias("chunk_size"),
        F.round(F.col("value") * 1000).cast("bigint").alias("rows_processed"),
        (F.col("user_id") % 101).cast("double").alias("ram_percent"),
        (F.col("event_id") % 101).cast("double").alias("cpu_percent"),
        F.col("value").alias("throughput"),
    )


METRICS = """m as (
  select event_type as run_id, ts, event_id as seq, (1 + user_id % 12)::bigint as num_workers,
    (50000 + event_id % 15 * 50000)::bigint as chunk_size, round(value * 1000)::bigint as rows_processed,
    (user_id % 101)::double as ram_percent, (event_id % 101)::double as cpu_percent,
    value as throughput
  from events)"""

LEVEL = """case when ram_percent >= 90 then 'GUARD RAM' when ram_percent >= 87 then 'NEAR RAM'
  when cpu_percent >= 98 then 'GUARD CPU' else 'normal' end"""

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
