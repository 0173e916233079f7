"""Standardizer, labels, feature matrix and its checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.catalog.inputs import (
    DIRTY,
    FEATURES,
    FINITE_PRICE,
    dirty_lines,
    r6,
    table,
    unsigned_zero,
)
from granary.operators import checks as K
from granary.operators import features as X
from granary.operators.schema import LABEL, standardize_label
from granary.session import shared_dir
from granary.sinks.tables import write_matrix
from granary.sources.tables import scan_dataset_artifact


def standardizer(spark, sf):
    stats = X.fit_standardizer(table(spark, sf, "lineitem"), FEATURES)
    return stats.select("name", "n", r6("mean").alias("mean"), r6("std").alias("std"))


def standardized(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("l_constant", F.lit(5.0))
    columns = [*FEATURES, "l_constant"]
    scaled = X.standardize(rows, X.fit_standardizer(rows, columns))
    return scaled.select("l_orderkey", "l_partkey", *[r6(c).alias(c) for c in columns])


def label_index(spark, sf):
    return X.fit_label_index(table(spark, sf, "orders"), "o_orderpriority")


def encoded(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return X.encode_labels(orders, X.fit_label_index(orders, "o_orderpriority"), "o_orderpriority")


def assembled(spark, sf):
    rows = X.assemble_features(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"),
                               ["o_custkey", "o_totalprice"])
    return rows.select(
        "o_orderkey",
        F.size("features").cast("bigint").alias("width"),
        F.get("features", F.lit(0)).alias("x0"),
        F.get("features", F.lit(1)).alias("x1"),
    )


def _matrix(spark, sf):
    rows = standardize_label(dirty_lines(spark, sf)).where(F.col(LABEL).isNotNull())
    return X.build_training_matrix(
        rows, cols=["l_quantity", "price", "l_tax"], keep=("l_orderkey", "l_partkey")
    )


def training_matrix(spark, sf):
    data = _matrix(spark, sf).data
    return data.select(
        "l_orderkey",
        "l_partkey",
        "label_idx",
        *[unsigned_zero(F.round(F.get("features", F.lit(i)), 5)).alias(f"x{i}") for i in range(3)],
    )


def matrix_artifact(spark, sf):
    """Write the matrix, read it back, and summarize it per class."""
    path = shared_dir(spark, "matrix")
    write_matrix(_matrix(spark, sf), path)
    data, meta = scan_dataset_artifact(spark, path)
    classes = meta.select(F.posexplode("classes").alias("label_idx", "label"))
    grouped = data.groupBy("label_idx").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.round(F.avg(F.get("features", F.lit(i))), 5).alias(f"mean_x{i}") for i in range(3)],
    )
    return grouped.join(F.broadcast(classes), "label_idx").select(
        "label", "rows", *[f"mean_x{i}" for i in range(3)]
    )


def written_matrix(spark, sf):
    """Write a matrix of orders, and join its rows with its label table again."""
    path = shared_dir(spark, "matrix")
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", LABEL)
    write_matrix(X.build_training_matrix(orders, cols=["o_totalprice"], keep=("o_orderkey",)), path)
    data, labels = spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/labels")
    value = unsigned_zero(F.round(F.get("features", F.lit(0)), 5)).alias("price")
    named = F.broadcast(labels.select("label_idx", F.col(LABEL).alias("label")))
    rows = data.select("o_orderkey", "label_idx", "features")  # without the label: its name differs only in case
    return rows.join(named, "label_idx").select("o_orderkey", "label", value)


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").alias("features"), F.col("label").alias("label_idx")
    )


def required_fields(spark, sf):
    # The parts of a matrix bundle: here the distinct languages stand for its names.
    parts = table(spark, sf, "documents").select(F.col("lang").alias("name")).distinct()
    return K.check_required_fields(parts, ("en", "xx", "yy"))


def row_alignment(spark, sf):
    return K.check_row_alignment(_vectors(spark, sf))


def width(spark, sf):
    return K.check_width(_vectors(spark, sf), 64)


def label_range(spark, sf):
    return K.check_label_range(_vectors(spark, sf), 9)


def column_alignment(spark, sf):
    here = table(spark, sf, "customer").select(F.col("c_nationkey").alias("name"))
    there = table(spark, sf, "nation").select((F.col("n_nationkey") + 3).alias("name"))
    return K.check_column_alignment(here.distinct(), there).withColumn("name", F.col("name").cast("bigint"))


def verdict(spark, sf):
    return K.verdict(K.all_checks(_vectors(spark, sf), 64, 10))


def column_stats(spark, sf):
    stats = X.column_stats(dirty_lines(spark, sf), ["price", "l_quantity", "l_tax"], distinct="exact")
    return stats.select(
        "name", "n", "n_inf", "n_nan", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
        "distinct_values",
    )


QUERIES = {
    "a9_scan_dataset_artifact": matrix_artifact,
    "f1_fit_standardizer": standardizer,
    "f2_standardize": standardized,
    "f3_fit_label_index": label_index,
    "f3_encode_labels": encoded,
    "f4_assemble_features": assembled,
    "f5_training_matrix": training_matrix,
    "f6_required_fields": required_fields,
    "f7_row_alignment": row_alignment,
    "f8_width": width,
    "f9_label_range": label_range,
    "f10_column_alignment": column_alignment,
    "f10_verdict": verdict,
    "f11_column_stats": column_stats,
    "k3_write_matrix": written_matrix,
}

_SCALED = ", ".join(
    f"round(({c} - avg({c}) over ()) / stddev_pop({c}) over (), 6) as {c}" for c in FEATURES
)
_STAT = """select '{0}' as name, count({0}) as n, round(avg({0}), 6) as mean,
  round(stddev_pop({0}), 6) as std from lineitem"""
_MATRIX = f"""{DIRTY}, kept as (select *, {FINITE_PRICE} as p from dirty where label is not null),
  filled as (select l_orderkey, l_partkey, label, l_quantity, coalesce(p, avg(p) over ()) as p, l_tax from kept),
  mx as (select l_orderkey, l_partkey, label, dense_rank() over (order by label) - 1 as label_idx,
    (l_quantity - avg(l_quantity) over ()) / stddev_pop(l_quantity) over () as x0,
    (p - avg(p) over ()) / stddev_pop(p) over () as x1,
    (l_tax - avg(l_tax) over ()) / stddev_pop(l_tax) over () as x2 from filled)"""
_COLUMN = """select '{0}' as name, count({0}) as n, count(*) filter (isinf({0})) as n_inf,
  count(*) filter (isnan({0})) as n_nan,
  round(avg(case when not isinf({0}) and not isnan({0}) then {0} end), 4) as mean,
  round(stddev_pop(case when not isinf({0}) and not isnan({0}) then {0} end), 4) as std,
  count(distinct {0}) as distinct_values from dirty"""

ORACLES = {
    "a9_scan_dataset_artifact": f"""with {_MATRIX} select label, count(*) as rows, round(avg(x0), 5) as mean_x0,
      round(avg(x1), 5) as mean_x1, round(avg(x2), 5) as mean_x2 from mx group by 1""",
    "f1_fit_standardizer": " union all ".join(_STAT.format(c) for c in FEATURES),
    "f2_standardize": f"select l_orderkey, l_partkey, {_SCALED}, 0.0::double as l_constant from lineitem",
    "f3_fit_label_index": """select distinct o_orderpriority,
      dense_rank() over (order by o_orderpriority) - 1 as label_idx from orders""",
    "f3_encode_labels": """select o_orderkey, o_orderpriority,
      dense_rank() over (order by o_orderpriority) - 1 as label_idx from orders""",
    "f4_assemble_features": """select o_orderkey, 2::bigint as width, o_custkey::double as x0,
      o_totalprice as x1 from orders""",
    "f5_training_matrix": f"""with {_MATRIX} select l_orderkey, l_partkey, label_idx, round(x0, 5) + 0 as x0,
      round(x1, 5) + 0 as x1, round(x2, 5) + 0 as x2 from mx""",
    "f6_required_fields": """with f as (select distinct lang from documents),
      lacking as (select v from (values ('en'), ('xx'), ('yy')) t(v) where v not in (select lang from f))
      select 'required_fields' as check_name, case when count(*) = 0 then 'OK' else 'ERROR' end as status,
        case when count(*) = 0 then '' else 'missing: ' || string_agg(v, ', ' order by v) end as detail
      from lacking""",
    "f7_row_alignment": """select 'row_alignment' as check_name,
      case when count(embedding) = count(label) then 'OK' else 'ERROR' end as status,
      count(embedding) || '/' || count(label) as detail from embeddings""",
    "f8_width": """select 'width' as check_name,
      case when min(len(embedding)) = 64 and max(len(embedding)) = 64 then 'OK' else 'ERROR' end as status,
      min(len(embedding)) || '..' || max(len(embedding)) || ' of 64' as detail from embeddings""",
    "f9_label_range": """select 'label_range' as check_name,
      case when min(label) >= 0 and max(label) < 9 then 'OK' else 'ERROR' end as status,
      min(label) || '..' || max(label) || ' of 9' as detail from embeddings""",
    "f10_column_alignment": """select 'matrix' as side, name from (
        select distinct c_nationkey::bigint as name from customer
        except select n_nationkey + 3 from nation)
      union all select 'table', name from (select n_nationkey::bigint + 3 as name from nation
        except select c_nationkey from customer)""",
    "f10_verdict": """select count(embedding) = count(label) and min(len(embedding)) = 64
      and max(len(embedding)) = 64 and min(label) >= 0 and max(label) < 10 as passed from embeddings""",
    "f11_column_stats": f"with {DIRTY} " + " union all ".join(
        _COLUMN.format(c) for c in ("price", "l_quantity", "l_tax")
    ),
}

ORACLES["k3_write_matrix"] = """select o_orderkey, o_orderpriority as label,
  round((o_totalprice - avg(o_totalprice) over ()) / stddev_pop(o_totalprice) over (), 5) + 0 as price from orders"""
