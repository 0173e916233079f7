"""Splits, samples, set operations and products."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.catalog.inputs import KEYS, RUNS, csv_export, folder_of, table, trial_runs
from granary.functions.scalars import params_text
from granary.operators import relations as R
from granary.operators import split as D
from granary.operators.clean import clip, null_out_infinities
from granary.operators.evaluation import param_grid
from granary.operators.schema import set_difference, union_all
from granary.sources.files import discover_files, plain_path
from granary.sources.tables import scan_csv


def split_events(spark, sf):
    rows = D.ratio_split(table(spark, sf, "events"), ["event_id"], 0.6, ("event_type",))
    return rows.select("event_id", "event_type", "split")


def split_orders(spark, sf):
    rows = D.ratio_split(
        table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], 0.75, ("o_orderstatus", "o_orderpriority")
    )
    return rows.select("o_orderkey", "split")


def split_texts(spark, sf):
    """In the order of whole texts, which begin alike by the hundreds."""
    rows = D.ratio_split(table(spark, sf, "documents"), ["text", "doc_id"], 0.6, ("lang",))
    return rows.select("doc_id", "split")


def clean_split_summary(spark, sf):
    """Clean the values, split per label in order, summarize: the flagship query."""
    events = table(spark, sf, "events")
    clean = events.transform(null_out_infinities, ["value"]).transform(clip, ["value"])
    rows = D.ratio_split(clean, ["event_id"], 0.6, ("event_type",))
    return rows.groupBy("event_type", "split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.sum(F.round(F.col("value") * 100).cast("bigint")) / 100.0, 2).alias("total"),
    )


def random_split(spark, sf):
    rows = D.random_split(table(spark, sf, "documents"), "doc_id", 0.6)
    return rows.select("doc_id", "split")


def summary(spark, sf):
    rows = D.ratio_split(table(spark, sf, "documents"), ["doc_id"], 0.6, ("source", "lang"))
    return D.split_summary(rows)


def stratified(spark, sf):
    return D.stratified_sample(table(spark, sf, "orders"), "o_orderkey", "o_orderpriority", 0.5).select(
        "o_orderkey", "o_orderpriority"
    )


def holdouts(spark, sf):
    rows = D.repeated_stratified_holdout(table(spark, sf, "events"), "event_id", "event_type")
    return rows.select("event_id", *[f"test_{i}" for i in range(D.HOLDOUTS)])


def distribution(spark, sf):
    rows = D.ratio_split(table(spark, sf, "orders"), ["o_orderkey"], 0.6, ("o_orderpriority",))
    return D.label_distribution(rows, "o_orderpriority")


def _documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "source")


def _finished(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("path"))


def pending_inputs(spark, sf):
    return R.pending_inputs(_documents(spark, sf), _finished(spark, sf))


def done_inputs(spark, sf):
    return R.done_inputs(_documents(spark, sf), _finished(spark, sf))


def _grid(spark, sf):
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("experiment_id"))
    return param_grid(suppliers)


def pending_trials(spark, sf):
    finished = trial_runs(spark, sf).select("experiment_id", "model", "combo_idx").distinct()
    return R.pending_trials(_grid(spark, sf), finished, KEYS).select(
        "experiment_id", "model", "combo_idx"
    )


def _artifacts(spark, sf):
    required = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("name"))
    found = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("name")).agg(
        F.count(F.lit(1)).alias("size")
    )
    return R.artifact_check(required, found)


def artifacts(spark, sf):
    return _artifacts(spark, sf)


def all_artifacts(spark, sf):
    return R.all_present(_artifacts(spark, sf))


def speeds(spark, sf):
    models = trial_runs(spark, sf).groupBy("experiment_id", "model").agg(F.count(F.lit(1)).alias("n"))
    return R.lookup_speed(models)


def appended(spark, sf):
    customer = table(spark, sf, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), "c_mktsegment"
    )
    supplier = table(spark, sf, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    return union_all([customer, supplier])


def labels(spark, sf):
    return R.distinct_labels(table(spark, sf, "orders"), "o_orderpriority")


def difference(spark, sf):
    customers = table(spark, sf, "orders").select(F.col("o_custkey").alias("name"))
    buyers = table(spark, sf, "orders").where(F.col("o_totalprice") > 250000)
    return set_difference(customers, buyers.select(F.col("o_custkey").alias("name")))


def product(spark, sf):
    lists = table(spark, sf, "part").select(
        "p_partkey",
        F.sequence(F.lit(1), 1 + F.col("p_size") % 3).alias("width"),
        F.array(F.lit("a"), F.lit("b")).alias("kind"),
        F.sequence(F.lit(1), 1 + (F.col("p_partkey") % 2).cast("int")).alias("depth"),
    )
    return R.grid_product(lists, ["width", "kind", "depth"]).select(
        "p_partkey", "combo_idx", F.col("width").cast("bigint").alias("width"), "kind",
        F.col("depth").cast("bigint").alias("depth"),
    )


def grid(spark, sf):
    return _grid(spark, sf).select(
        "experiment_id", "model", "combo_idx", params_text("params").alias("params")
    )


def sorted_paths(spark, sf):
    """Rows of the tables by the rank of their file's folder in the sorted listing."""
    found = discover_files(spark, csv_export(spark, sf))
    places = found.select("path", F.dense_rank().over(Window.orderBy(folder_of("path"))).alias("place"))
    rows = scan_csv(spark, files=found).groupBy(plain_path("source").alias("at")).count()
    held = places.join(rows, F.col("path") == F.col("at"))
    return held.groupBy("place", folder_of("path").alias("folder")).agg(F.sum("count").alias("rows")).orderBy("place")


def newest_events(spark, sf):
    return R.newest(table(spark, sf, "events"), ["ts", "event_id"]).select("event_id", "event_type")


def last_per_user(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return R.dedupe_last(events, "user_id", "event_id", "event_type")


QUERIES = {
    "d0_clean_split_summary": clean_split_summary,
    "d1_ratio_split": split_events,
    "d1_ratio_split_two_keys": split_orders,
    "d1_ratio_split_by_text": split_texts,
    "d2_random_split": random_split,
    "d3_split_summary": summary,
    "d4_stratified_sample": stratified,
    "d5_repeated_holdout": holdouts,
    "e1_pending_inputs": pending_inputs,
    "e1_done_inputs": done_inputs,
    "e2_pending_trials": pending_trials,
    "e3_artifact_check": artifacts,
    "e3_all_present": all_artifacts,
    "e4_lookup_speed": speeds,
    "e5_union_all": appended,
    "e6_distinct_labels": labels,
    "e7_set_difference": difference,
    "e8_grid_product": product,
    "f12_label_distribution": distribution,
    "g1_param_grid": grid,
    "h10_dedupe_last": last_per_user,
    "s2_sorted_paths": sorted_paths,
    "s6_newest": newest_events,
}


def _split_sql(table_name: str, by: str, order: str, ratio: float) -> str:
    return f"""select *, case when round_even(n * {ratio}::double, 0) > round_even((n - 1) * {ratio}::double, 0)
      then 'train' else 'test' end as split
      from (select *, row_number() over (partition by {by} order by {order})::double as n from {table_name})"""


def _hash_sql(key: str, seed) -> str:
    return f"md5(concat({key}, '-', {seed}))"


_HOLDOUTS = ", ".join(
    f"""row_number() over (partition by event_type order by {_hash_sql("event_id", 42 + i)}, event_id)
      <= round_even(count(*) over (partition by event_type) * 0.2::double, 0) as test_{i}"""
    for i in range(5)
)

# The grids as SQL, the last parameter fastest.
GRID_SQL = """g(model, combo_idx, params) as (
  select 'Logistic Regression', row_number() over (order by i, j), 'C=' || c || ', max_iter=' || m || ', penalty=l2'
  from (values (1, '0.1'), (2, '1'), (3, '10')) c(i, c), (values (1, '1000'), (2, '2000')) m(j, m)
  union all
  select 'Naive Bayes', i, 'var_smoothing=' || v from (values (1, '1e-09'), (2, '1e-08'), (3, '1e-07')) v(i, v)
  union all
  select 'Decision Tree', row_number() over (order by d, s, l),
    'max_depth=' || d || ', min_samples_split=' || s || ', min_samples_leaf=' || l
  from (values (10), (15), (20)) d(d), (values (5), (10), (20)) s(s), (values (2), (5), (10)) l(l)
  union all
  select 'Random Forest', row_number() over (order by n, d, s, l),
    'n_estimators=' || n || ', max_depth=' || d || ', min_samples_split=' || s || ', min_samples_leaf=' || l
  from (values (50), (100), (200)) n(n), (values (15), (20)) d(d), (values (5), (10)) s(s),
    (values (2), (5)) l(l))"""

_ARTIFACTS = """a as (
  select c_custkey::varchar as name, f.size, case when f.size is null then 'missing' else 'OK' end as status
  from customer left join (select o_custkey, count(*) as size from orders group by 1) f
    on f.o_custkey = c_custkey)"""

ORACLES = {
    "d0_clean_split_summary": f"""select event_type, split, count(*) as rows,
      round(sum(round(value * 100)::bigint) / 100.0::double, 2) as total
      from ({_split_sql("events", "event_type", "event_id", 0.6)}) group by 1, 2""",
    "d1_ratio_split": f"""select event_id, event_type, split
      from ({_split_sql("events", "event_type", "event_id", 0.6)})""",
    "d1_ratio_split_two_keys": f"""select o_orderkey, split from ({_split_sql(
        "orders", "o_orderstatus, o_orderpriority", "o_orderdate, o_orderkey", 0.75)})""",
    "d1_ratio_split_by_text": f"""select doc_id, split from ({_split_sql("documents", "lang", "text, doc_id", 0.6)})""",
    "d2_random_split": f"""select doc_id, case when
      cast(concat('0x', substring({_hash_sql("doc_id", 42)}, 1, 8)) as bigint) / 4294967296.0::double < 0.6
      then 'train' else 'test' end as split from documents""",
    "d3_split_summary": f"""select source, count(*) filter (split = 'train') as train_rows,
      count(*) filter (split = 'test') as test_rows, count(*) as rows
      from ({_split_sql("documents", "source, lang", "doc_id", 0.6)}) group by rollup (source)""",
    "d4_stratified_sample": f"""select o_orderkey, o_orderpriority from orders
      qualify row_number() over (partition by o_orderpriority order by {_hash_sql("o_orderkey", 42)}, o_orderkey)
        <= floor(count(*) over (partition by o_orderpriority) * 0.5)""",
    "d5_repeated_holdout": f"select event_id, {_HOLDOUTS} from events",
    "e1_pending_inputs": """select doc_id as path, source from documents
      where doc_id not in (select doc_id from labels)""",
    "e1_done_inputs": """select doc_id as path, source from documents
      where doc_id in (select doc_id from labels)""",
    "e2_pending_trials": f"""with {RUNS}, {GRID_SQL}
      select s_suppkey as experiment_id, g.model, g.combo_idx from supplier, g
      where not exists (select 1 from runs r where r.experiment_id = s_suppkey
        and r.model = g.model and r.combo_idx = g.combo_idx)""",
    "e3_artifact_check": f"with {_ARTIFACTS} select * from a",
    "e3_all_present": f"with {_ARTIFACTS} select bool_and(status = 'OK') as all_ok from a",
    "e4_lookup_speed": f"""with {RUNS} select model, experiment_id, count(*) as n,
      case model when 'Logistic Regression' then 0.9 when 'Naive Bayes' then 1.0 else 0.5 end::double as speed
      from runs group by 1, 2""",
    "e5_union_all": """select c_name as name, c_acctbal as balance, c_mktsegment from customer
      union all select s_name, s_acctbal, null from supplier""",
    "e6_distinct_labels": "select distinct o_orderpriority from orders order by 1",
    "e7_set_difference": """select distinct o_custkey as name from orders
      where o_custkey not in (select o_custkey from orders where o_totalprice > 250000)""",
    "e8_grid_product": """with w as (select p_partkey, unnest(range(1, 2 + p_size % 3)) as width, p_size from part),
      k as (select *, unnest(['a', 'b']) as kind from w),
      d as (select *, unnest(range(1, 2 + p_partkey % 2)) as depth from k)
      select p_partkey, row_number() over (partition by p_partkey order by width, kind, depth) as combo_idx,
        width, kind, depth from d""",
    "f12_label_distribution": f"""select o_orderpriority, split, count(*) as rows
      from ({_split_sql("orders", "o_orderpriority", "o_orderkey", 0.6)})
      group by rollup (o_orderpriority, split)""",
    "g1_param_grid": f"with {GRID_SQL} select s_suppkey as experiment_id, g.* from supplier, g",
    "h10_dedupe_last": """select user_id, min(event_id) as first_position,
      arg_max(event_type, event_id) as event_type from events group by 1""",
    "s2_sorted_paths": """select 1 as place, 'customer' as folder, count(*) as rows from customer
      union all select 2, 'part', count(*) from part union all select 3, 'supplier', count(*) from supplier""",
    "s6_newest": "select event_id, event_type from events order by ts desc, event_id desc limit 300",
}
