"""Scans, sources, samples and schema operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.catalog.inputs import csv_export, folder_of, table
from granary.operators import schema as S
from granary.operators.clean import cast_label
from granary.session import INTERMEDIATES, shared_dir
from granary.sources import files, tables


def discover(spark, sf):
    """Every file found, and per folder the rows that a scan reads from the files of the listing."""
    found = files.discover_files(spark, csv_export(spark, sf))
    rows = tables.scan_csv(spark, files=found).groupBy(files.plain_path("source").alias("at")).count()
    listed = found.where(F.col("size") > 0).join(rows, F.col("path") == F.col("at"), "left")
    return listed.groupBy(
        folder_of("path").alias("folder"), F.lower(F.regexp_extract("name", r"\.[^.]+$", 0)).alias("ext")
    ).agg(F.sum(F.coalesce("count", F.lit(0))).cast("bigint").alias("rows"))


_HEADERS: dict[str, str] = {}


def _headers(spark, sf):
    """Header rows of the export, read from its files once."""
    root = csv_export(spark, sf)
    if _HEADERS.get(root) not in INTERMEDIATES:
        rows = files.header_inventory(spark, root)
        path = shared_dir(spark, "header-rows")
        rows.select(folder_of("path").alias("path"), "pos", "name").distinct().write.parquet(path)
        _HEADERS[root] = path
    return spark.read.schema("path string, pos bigint, name string").parquet(_HEADERS[root])


def headers(spark, sf):
    return _headers(spark, sf).withColumnRenamed("path", "folder")


def scan(spark, sf):
    rows = tables.typed(tables.scan_csv(spark, csv_export(spark, sf)))
    return rows.withColumn("source", folder_of("source"))


def sample(spark, sf):
    events = table(spark, sf, "events")
    return tables.scan_sample(events, ["event_id"], 100, "event_type").select(
        "event_type", "event_id", "value"
    )


def head_per_source(spark, sf):
    """The first three texts of every source, in the order of whole texts."""
    documents = table(spark, sf, "documents")
    return tables.scan_sample(documents, ["text", "doc_id"], 3, "source").select("source", "doc_id")


def _texts(spark, sf):
    key = F.col("event_id")
    return table(spark, sf, "events").select(
        key.cast("string").alias("id"),
        F.when(key % 10 != 0, F.col("user_id").cast("string")).otherwise("NA").alias("holed"),
        F.when(key % 7 == 0, "inf").otherwise(F.format_string("%.2f", "value")).alias("amount"),
        F.when(key % 2 == 0, "True").otherwise("False").alias("flag"),
        "event_type",
        F.lit(None).cast("string").alias("empty"),
    )


def infer(spark, sf):
    return S.infer_types(_texts(spark, sf))


def counts(spark, sf):
    return tables.count_rows(table(spark, sf, "events"), 2000, ["event_type"])


def row_sizes(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    sizes = tables.row_size_profile(events, 2000, 1_000_000)
    return sizes.withColumn("bytes_per_row", F.round("bytes_per_row", 6))


def union_columns(spark, sf):
    return S.union_schema(_headers(spark, sf))


def _labelled_customers(spark, sf):
    return table(spark, sf, "customer").withColumnRenamed("c_mktsegment", " label ")


def standard_label(spark, sf):
    return S.standardize_label(_labelled_customers(spark, sf)).select("c_custkey", "Label")


def aligned(spark, sf):
    columns = ["c_name", "extra", "c_custkey", "score"]
    return S.align_to_schema(table(spark, sf, "customer"), columns, {"score": "double"})


def consolidated(spark, sf):
    return S.consolidate(
        {
            "customer": _labelled_customers(spark, sf),
            "supplier": table(spark, sf, "supplier").withColumnRenamed("s_name", "LABEL"),
            "part": table(spark, sf, "part"),
        }
    )


def dropped(spark, sf):
    return S.dropped_rows(consolidated(spark, sf))


def _one_header(spark, sf, folder):
    return _headers(spark, sf).where(F.col("path") == folder).select("pos", "name")


def equal_headers(spark, sf):
    pairs = [("customer", "customer"), ("customer", "supplier"), ("supplier", "part")]
    out = None
    for a, b in pairs:
        same = S.schema_equal(_one_header(spark, sf, a), _one_header(spark, sf, b))
        row = same.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "equal")
        out = row if out is None else out.unionByName(row)
    return out


def missing_names(spark, sf):
    customer = _one_header(spark, sf, "customer")
    merged = S.union_schema(_headers(spark, sf))
    return S.schema_missing(customer, merged, "customer", "union")


def type_differences(spark, sf):
    texts = _texts(spark, sf)
    other = texts.select(
        "id",
        F.regexp_replace("holed", "NA", "0").alias("holed"),
        "event_type",
        F.lit("x").alias("empty"),
        F.lit("1").alias("extra"),
    )
    return S.dtype_diff(S.infer_types(texts), S.infer_types(other))


def numeric(spark, sf):
    orders = cast_label(
        S.standardize_label(table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "Label"))
    )
    return S.numeric_profile(S.infer_types(orders))


def fingerprints(spark, sf):
    return S.fingerprint_relation(_headers(spark, sf)).withColumnRenamed("path", "folder")


QUERIES = {
    "a1_discover_files": discover,
    "a2_header_inventory": headers,
    "a3_scan_csv": scan,
    "a4_scan_sample": sample,
    "a5_infer_types": infer,
    "a7_count_rows": counts,
    "a8_row_size_profile": row_sizes,
    "b1_union_schema": union_columns,
    "b2_standardize_label": standard_label,
    "b3_align_to_schema": aligned,
    "b4_consolidate": consolidated,
    "b4_dropped_rows": dropped,
    "b5_schema_equal": equal_headers,
    "b6_schema_missing": missing_names,
    "b7_dtype_diff": type_differences,
    "b8_numeric_columns": numeric,
    "b9_schema_fingerprint": fingerprints,
    "s1_sorted_columns": union_columns,
    "s7_head_per_source": head_per_source,
}

_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", " label "]
_SUPPLIER = ["s_suppkey", "LABEL", "s_nationkey", "s_acctbal"]
_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
_HEADERS = {"customer": _CUSTOMER, "supplier": _SUPPLIER, "part": _PART}

_HEADER_ROWS = "h(folder, pos, name) as (values " + ", ".join(
    f"('{folder}', {i}::bigint, '{name}')"
    for folder, names in _HEADERS.items()
    for i, name in enumerate(names, 1)
) + ")"

_UNION_ROWS = f"""{_HEADER_ROWS}, n as (
  select distinct case when lower(trim(name)) = 'label' then 'Label' else name end as name from h),
u as (select row_number() over (order by name = 'Label', lower(name), name) as pos, name from n)"""

_CONSOLIDATED = """
  select 'customer' as source, c_acctbal, c_custkey, c_name, c_nationkey, null::varchar as p_brand,
    null::varchar as p_name, null::bigint as p_partkey, null::double as p_retailprice,
    null::integer as p_size, null::varchar as p_type, null::double as s_acctbal,
    null::integer as s_nationkey, null::bigint as s_suppkey, c_mktsegment as "Label" from customer
  union all
  select 'part', null, null, null, null, p_brand, p_name, p_partkey, p_retailprice, p_size, p_type,
    null, null, null, null from part
  union all
  select 'supplier', null, null, null, null, null, null, null, null, null, null,
    s_acctbal, s_nationkey, s_suppkey, s_name from supplier"""

_TEXTS = """t as (
  select event_id::varchar as id, case when event_id % 10 <> 0 then user_id::varchar end as holed,
    case when event_id % 7 = 0 then 'inf' else printf('%.2f', value) end as amount,
    case when event_id % 2 = 0 then 'True' else 'False' end as flag, event_type,
    null::varchar as empty from events)"""


def _type_of(source: str, column: str) -> str:
    return f"""select '{column}' as name, case
      when count({column}) = 0 then 'float64'
      when count(*) = count({column}) and bool_and(regexp_matches({column}, '^[+-]?[0-9]+$'))
        filter (where {column} is not null) then 'int64'
      when bool_and(try_cast({column} as double) is not null) filter (where {column} is not null)
        then 'float64'
      when count(*) = count({column}) and bool_and({column} in ('True', 'False')) then 'bool'
      else 'object' end as dtype from {source}"""


_TYPES = " union all ".join(
    _type_of("t", c) for c in ("id", "holed", "amount", "flag", "event_type", "empty")
)
_OTHER_TYPES = " union all ".join(
    _type_of("o", c) for c in ("id", "holed", "event_type", "empty", "extra")
)

ORACLES = {
    "a1_discover_files": """select 'customer' as folder, '.csv' as ext, count(*) as rows from customer
      union all select 'supplier', '.csv', count(*) from supplier
      union all select 'part', '.csv', count(*) from part""",
    "a8_row_size_profile": """with e as (select len(event_id || ',' || user_id || ',' || event_type) as w
        from events order by event_id limit 2000)
      select count(*) as sampled_rows, round(avg(w), 6) as bytes_per_row,
        floor(1000000 / avg(w))::bigint as estimated_rows from e""",
    "a2_header_inventory": f"with {_HEADER_ROWS} select * from h",
    "a3_scan_csv": "select * from (" + _CONSOLIDATED + ")",
    "a4_scan_sample": """select event_type, event_id, value from events
      qualify row_number() over (partition by event_type order by event_id) <= 100""",
    "a5_infer_types": f"with {_TEXTS} {_TYPES}",
    "a7_count_rows": "select event_type, least(count(*), 2000) as rows from events group by 1",
    "b1_union_schema": f"with {_UNION_ROWS} select * from u",
    "b2_standardize_label": 'select c_custkey, c_mktsegment as "Label" from customer',
    "b3_align_to_schema": """select c_name, null::varchar as extra, c_custkey, null::double as score
      from customer""",
    "b4_consolidate": _CONSOLIDATED,
    "b4_dropped_rows": f"""select source, count(*) as rows, count(*) filter ("Label" is null) as dropped
      from ({_CONSOLIDATED}) group by 1""",
    "b5_schema_equal": f"""with {_HEADER_ROWS}, pairs(a, b) as (values
      ('customer', 'customer'), ('customer', 'supplier'), ('supplier', 'part'))
      select a, b, (select list(name order by pos) from h where folder = a)
        = (select list(name order by pos) from h where folder = b) as equal from pairs""",
    "b6_schema_missing": f"""with {_UNION_ROWS}
      select 'customer' as side, pos, name from h
      where folder = 'customer' and name not in (select name from u)
      union all select 'union', pos, name from u
      where name not in (select name from h where folder = 'customer')""",
    "b7_dtype_diff": f"""with {_TEXTS}, o as (select id, coalesce(holed, '0') as holed, event_type,
        'x' as empty, '1' as extra from t),
      a as ({_TYPES}), b as ({_OTHER_TYPES})
      select name, a.dtype as a_dtype, b.dtype as b_dtype from a full join b using (name)
      where a.dtype is distinct from b.dtype""",
    "b8_numeric_columns": """select name, case when holes = 0 then dtype else 'float64' end as dtype from (
      select 'o_orderkey' as name, 'int64' as dtype, count(*) - count(o_orderkey) as holes from orders
      union all select 'o_custkey', 'int64', count(*) - count(o_custkey) from orders
      union all select 'o_totalprice', 'float64', min(0) from orders)""",
    "b9_schema_fingerprint": f"""with {_HEADER_ROWS} select folder,
      substr(sha1('["' || string_agg(name, '","' order by pos) || '"]'), 1, 10) as fingerprint
      from h group by 1""",
}

ORACLES["s1_sorted_columns"] = ORACLES["b1_union_schema"]
ORACLES["s7_head_per_source"] = """select source, doc_id from documents
  qualify row_number() over (partition by source order by text, doc_id) <= 3"""
