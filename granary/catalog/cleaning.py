"""Narrowing, infinities, clipping, imputation, label rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.catalog.inputs import DIRTY, FINITE_PRICE, dirty_lines, r6, table
from granary.operators import clean as C

KEYS = ["l_orderkey", "l_partkey", "l_linenumber"]


def integer_ranges(spark, sf):
    return C.integer_ranges(table(spark, sf, "lineitem"))


def narrow_integers(spark, sf):
    df = table(spark, sf, "lineitem").select(*KEYS)
    return C.narrow_integers(df).select(*[F.col(c).cast("bigint").alias(c) for c in KEYS])


def narrow_floats(spark, sf):
    df = table(spark, sf, "lineitem").select(*KEYS, "l_extendedprice")
    narrowed = C.narrow_floats(df, ["l_extendedprice"])
    return narrowed.select(*KEYS, F.col("l_extendedprice").cast("double").alias("price32"))


def low_cardinality(spark, sf):
    part = table(spark, sf, "part")
    holed = part.withColumn("p_type", F.when(F.col("p_size") > 5, F.col("p_type")))
    unique = holed.withColumn("p_unique", F.concat_ws("#", "p_name", "p_partkey"))
    return C.low_cardinality_columns(unique)


def no_infinities(spark, sf):
    return C.null_out_infinities(dirty_lines(spark, sf), ["price"]).select(*KEYS, "price")


def clipped(spark, sf):
    finite = C.null_out_infinities(dirty_lines(spark, sf), ["price"])
    return C.clip(finite, ["price", "l_quantity"], 10.0, 1e6).select(*KEYS, "price", "l_quantity")


def coerced(spark, sf):
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.col("value").cast("string"))
    return C.coerce_numeric(
        table(spark, sf, "events").select("event_id", text.alias("raw")), ["raw"]
    )


def imputed(spark, sf):
    finite = C.null_out_infinities(dirty_lines(spark, sf), ["price"])
    return C.impute_mean(finite, ["price"]).select(*KEYS, r6("price").alias("price"))


def imputed_by_group(spark, sf):
    finite = C.null_out_infinities(dirty_lines(spark, sf), ["price"])
    return C.impute_mean(finite, ["price"], " Label ").select(*KEYS, r6("price").alias("price"))


def labelled(spark, sf):
    return C.drop_null_labels(dirty_lines(spark, sf), " Label ").select(*KEYS)


def finite_counts(spark, sf):
    return C.finite_report(dirty_lines(spark, sf), ["price", "l_quantity"])


def repaired(spark, sf):
    fixed, _found = C.validate_finite(dirty_lines(spark, sf), ["price", "l_quantity"])
    return fixed.select(*KEYS, "price", "l_quantity")


def text_label(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("Label"))
    return C.cast_label(df)


def sanitized(spark, sf):
    columns = ["l_orderkey", "l_quantity", "missing", "price", "Label"]
    clean = C.sanitize(dirty_lines(spark, sf), columns)
    return clean.select(
        F.col("l_orderkey").cast("bigint").alias("l_orderkey"),
        F.col("l_quantity").cast("double").alias("l_quantity"),
        "missing",
        F.col("price").cast("double").alias("price"),
        "Label",
    )


def projected(spark, sf):
    return C.project_features(table(spark, sf, "lineitem"), ["l_partkey", "l_quantity", "l_tax"])


QUERIES = {
    "c1_integer_ranges": integer_ranges,
    "c1_narrow_integers": narrow_integers,
    "c2_narrow_floats": narrow_floats,
    "c3_low_cardinality": low_cardinality,
    "c4_null_out_infinities": no_infinities,
    "c5_clip": clipped,
    "c6_coerce_numeric": coerced,
    "c7_impute_mean": imputed,
    "c7_impute_mean_by_group": imputed_by_group,
    "c8_drop_null_labels": labelled,
    "c9_finite_report": finite_counts,
    "c9_validate_finite": repaired,
    "c10_cast_label": text_label,
    "c11_sanitize": sanitized,
    "c12_project_features": projected,
}

_RANGE = """select '{0}' as name, min({0})::bigint as low, max({0})::bigint as high, case
  when min({0}) >= -128 and max({0}) <= 127 then 'tinyint'
  when min({0}) >= -32768 and max({0}) <= 32767 then 'smallint'
  when min({0}) >= -2147483648 and max({0}) <= 2147483647 then 'int' else 'bigint' end as dtype
  from lineitem"""
_KEYS = ", ".join(KEYS)
_CARD = """select '{0}' as name, count(*) as rows,
  count(distinct {0}) + max(case when {0} is null then 1 else 0 end) as distinct_values from p"""

ORACLES = {
    "c1_integer_ranges": " union all ".join(
        _RANGE.format(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    ),
    "c1_narrow_integers": """select l_orderkey, l_partkey, l_linenumber::bigint as l_linenumber
      from lineitem""",
    "c2_narrow_floats": f"select {_KEYS}, l_extendedprice::float::double as price32 from lineitem",
    "c3_low_cardinality": f"""with p as (select p_name, p_brand,
        case when p_size > 5 then p_type end as p_type, p_name || '#' || p_partkey as p_unique from part),
      c as ({" union all ".join(_CARD.format(c) for c in ("p_name", "p_brand", "p_type", "p_unique"))})
      select *, distinct_values / greatest(rows, 1) < 0.5 or distinct_values < 50 as is_categorical from c""",
    "c4_null_out_infinities": f"with {DIRTY} select {_KEYS}, {FINITE_PRICE} as price from dirty",
    "c5_clip": f"""with {DIRTY}, f as (select *, {FINITE_PRICE} as p from dirty)
      select {_KEYS}, case when p > 1e6 then 1e6 when p < 10 then 10 else p end as price,
        case when l_quantity > 1e6 then 1e6 when l_quantity < 10 then 10 else l_quantity end as l_quantity
      from f""",
    "c6_coerce_numeric": """select event_id, case when event_id % 3 = 0 then null else value end as raw
      from events""",
    "c7_impute_mean": f"""with {DIRTY}, f as (select *, {FINITE_PRICE} as p from dirty)
      select {_KEYS}, round(coalesce(p, (select avg(p) from f), 0), 6) as price from f""",
    "c7_impute_mean_by_group": f"""with {DIRTY}, f as (select *, {FINITE_PRICE} as p from dirty)
      select {_KEYS}, round(coalesce(p, avg(p) over (partition by label), 0), 6) as price from f""",
    "c8_drop_null_labels": f"with {DIRTY} select {_KEYS} from dirty where label is not null",
    "c9_finite_report": f"""with {DIRTY} select count(*) filter (isinf(price)) as n_inf,
      count(*) filter (isnan(price)) as n_nan from dirty""",
    "c9_validate_finite": f"""with {DIRTY} select {_KEYS}, case when price is null or isnan(price) then 0
      when isinf(price) then 1e6 else price end as price, l_quantity from dirty""",
    "c10_cast_label": 'select vec_id, label::varchar as "Label" from embeddings',
    "c11_sanitize": f"""with {DIRTY}, f as (select *, ({FINITE_PRICE})::float as p from dirty)
      select l_orderkey, l_quantity::float::double as l_quantity, null::varchar as missing,
        (case when p > 1e6 then 1e6 when p < -1e6 then -1e6 else p end)::double as price,
        label as "Label" from f where label is not null""",
    "c12_project_features": """select l_partkey::double as l_partkey, l_quantity, l_tax
      from lineitem""",
}
