"""Sinks, reports and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.catalog.inputs import BEST, KEYS, TRIALS, table, trials
from granary.functions import scalars as X
from granary.operators.evaluation import best_per_model
from granary.operators.split import ratio_split, split_summary
from granary.catalog.splits import ORACLES as SPLIT_ORACLES
from granary.session import shared_dir
from granary.sinks import reports as P
from granary.sinks import tables as K


def _split(spark, sf):
    return ratio_split(table(spark, sf, "events"), ["event_id"], 0.6, ("event_type",))


def parts(spark, sf):
    """Write the parts, read them back by folder, and count."""
    path = shared_dir(spark, "parts")
    K.write_parts(_split(spark, sf).withColumnRenamed("event_type", "source"), path)
    return spark.read.parquet(path).groupBy("source", "split", "source_key").agg(
        F.count(F.lit(1)).alias("rows")
    )


def final_tables(spark, sf):
    root = shared_dir(spark, "final")
    rows = _split(spark, sf).select("event_id", "event_type", "split")
    K.write_split(rows, f"{root}/train", f"{root}/test", "csv")

    def read(side):
        back = spark.read.option("header", "true").schema("event_id bigint, event_type string").csv(
            f"{root}/{side}"
        )
        return back.withColumn("split", F.lit(side))

    return read("train").unionByName(read("test"))


def manifest(spark, sf):
    path = shared_dir(spark, "manifest")
    rows = split_summary(_split(spark, sf).withColumnRenamed("event_type", "source")).where("source is null")
    total = rows.first()
    columns = table(spark, sf, "events").columns
    K.write_manifest(spark, path, run_id="r1", stage="split", columns=columns, full_run=True)
    K.write_manifest(
        spark, path, run_id="r1", stage="done", columns=columns, full_run=True,
        rows_written_train=total["train_rows"], rows_written_test=total["test_rows"],
    )
    return K.read_manifest(spark, path).select(
        "run_id", "stage", "union_cols", "union_cols_hash", "rows_written_train", "rows_written_test"
    )


def _best(spark, sf):
    return best_per_model(trials(spark, sf), KEYS)


def report_text(spark, sf):
    best = _best(spark, sf)
    lines = P.report_lines(best.withColumn("model", F.concat_ws(" ", "model", "experiment_id")))
    return lines.select("model", "line", "params_line")


def report_json(spark, sf):
    best = _best(spark, sf).withColumn("f1_score", F.round("f1_score", 4))
    return P.report_json(best.withColumn("model", F.concat_ws(" ", "model", "experiment_id")))


def export_json(spark, sf):
    document = P.export_json(_best(spark, sf), KEYS, F.lit("2024-01-02 03:04:05").cast("timestamp"))
    fields = "timestamp string, summary struct<n_models: bigint, best_score: double>"
    parsed = document.withColumn("d", F.from_json("document", fields))
    return parsed.select(
        *KEYS, "d.timestamp", F.col("d.summary.n_models").alias("n_models"),
        F.round("d.summary.best_score", 6).alias("best_score"),
    )


def run_summary(spark, sf):
    """The event log as the manifest of runs, the table folder as their output."""
    log = table(spark, sf, "events").select(
        F.col("event_type").alias("run_id"), F.col("ts").cast("timestamp").alias("last_update_ts")
    )
    found = P.run_summary(spark, log, sf, ["events.parquet", "model.parquet"])
    return found.select("run_id", "finished", "duration", "name", "status")


def text_functions(spark, sf):
    docs = table(spark, sf, "documents")
    place = F.concat_ws("/", F.lit("/data"), "lang", F.concat("source", F.lit(".CSV")))
    return docs.select(
        "doc_id",
        X.sha1_10("text").alias("digest"),
        X.human_bytes(F.col("n_chars") * F.col("doc_id")).alias("size"),
        X.file_size_text(F.col("n_chars") * 4096).alias("file_size"),
        X.is_label_name(F.concat(F.lit(" "), F.upper(F.lit("label")))).alias("is_label"),
        X.has_suffix(place, ".csv").alias("is_csv"),
        X.basename(place).alias("base"),
        X.thousands("n_chars").alias("grouped"),
        X.fixed_decimals(F.col("n_chars") / 8, 4).alias("fixed"),
    )


def number_functions(spark, sf):
    events = table(spark, sf, "events")
    value = F.col("value")
    return events.select(
        "event_id",
        X.half_even(F.col("event_id") / 2).cast("bigint").alias("rounded"),
        X.clip(value, 1.0, 20.0).alias("clipped"),
        F.round(X.safe_divide(value, F.col("event_id") % 3), 6).alias("divided"),
        X.datetime_text(X.epoch_to_timestamp(1_700_000_000 + F.col("event_id") * 61)).alias("moment"),
        X.clock_text(X.epoch_to_timestamp(1_700_000_000 + F.col("event_id") * 61)).alias("clock"),
        X.hms(F.col("event_id") * 97).alias("span"),
        X.hms_padded(F.col("event_id") * 97).alias("span_padded"),
        X.hours_minutes(F.col("event_id") * 97).alias("span_short"),
        X.canonical_value(F.col("event_id").cast("string")).alias("canonical"),
    )


def nested_functions(spark, sf):
    events = table(spark, sf, "events")
    parsed = X.parse_json("props", "map<string, bigint>")
    x = F.array(F.lit(1.0), F.col("value"))
    y = F.array((F.col("event_id") % 5).cast("double"), F.lit(2.0))
    return events.withColumn("m", parsed).select(
        "event_id",
        X.map_get("m", "k", -1).alias("k"),
        X.map_get("m", "absent", -1).alias("absent"),
        X.map_size("m").alias("entries"),
        X.json_text("m").alias("json"),
        X.params_text(F.transform_values("m", lambda k, v: v.cast("string"))).alias("pairs"),
        F.round(X.dot(x, y), 6).alias("dot"),
        F.round(F.get(X.outer(x, y), F.lit(2)), 6).alias("outer_2"),
        F.round(X.quadratic_form(x, [[1.0, 0.5], [0.5, 2.0]]), 6).alias("form"),
        F.round(X.mean_of(x), 6).alias("mean"),
        F.round(X.std_pop_of(x), 6).alias("std"),
        F.round(X.coefficient_of_variation(X.mean_of(x), X.std_pop_of(x)), 6).alias("cv"),
    )


QUERIES = {
    "k1_write_parts": parts,
    "k2_write_split": final_tables,
    "k4_write_manifest": manifest,
    "k6_report_text": report_text,
    "k7_report_json": report_json,
    "k7_export_json": export_json,
    "k8_run_summary": run_summary,
    "x_text_functions": text_functions,
    "x_number_functions": number_functions,
    "x_nested_functions": nested_functions,
}

_SPLIT = SPLIT_ORACLES["d1_ratio_split"]
_SIZE = "(n_chars * doc_id)::double"
_MODEL = "model || ' ' || experiment_id"


def _unit(power: int, unit: str) -> str:
    value = f"{_SIZE} / {1024.0 ** power}::double"
    return f"printf('%.1f{unit}', {value})"


ORACLES = {
    "k1_write_parts": f"""select event_type as source, split, substr(sha1(event_type), 1, 10) as source_key,
      count(*) as rows from ({_SPLIT}) group by 1, 2""",
    "k2_write_split": _SPLIT,
    "k4_write_manifest": f"""with s as ({_SPLIT}),
      c as (select '["event_id","ts","user_id","event_type","value","props"]' as union_cols)
      select 'r1' as run_id, 'done' as stage, union_cols, substr(sha1(union_cols), 1, 10) as union_cols_hash,
        (select count(*) from s where split = 'train') as rows_written_train,
        (select count(*) from s where split = 'test') as rows_written_test from c""",
    "k6_report_text": f"""with {TRIALS}, {BEST} select {_MODEL} as model,
      printf('%-25s F1:%7.4f', {_MODEL}, f1_score) as line,
      '  Params: C=' || p_c || ', max_iter=' || p_iter as params_line from best""",
    "k7_report_json": f"""with {TRIALS}, {BEST} select {_MODEL} as model,
      '{{"params":{{"C":"' || p_c || '","max_iter":"' || p_iter || '"}},"f1_score":' || round(f1_score, 4) || '}}'
      as config from best""",
    "k7_export_json": f"""with {TRIALS}, {BEST} select experiment_id, '20240102_030405' as timestamp,
      count(*) as n_models, round(max(f1_score), 6) as best_score from best group by 1""",
    "k8_run_summary": """with r as (select event_type as run_id, max(ts) as finished,
        epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000 as s from events group by 1)
      select run_id, strftime(finished, '%Y-%m-%d %H:%M:%S') as finished,
        (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' as duration, name, status
      from r, (values ('events.parquet', 'OK'), ('model.parquet', 'missing')) a(name, status)""",
    "x_text_functions": f"""select doc_id, substr(sha1(text), 1, 10) as digest,
      case when {_SIZE} < 1024 then {_unit(0, "B")} when {_SIZE} < 1048576 then {_unit(1, "KB")}
        when {_SIZE} < 1073741824 then {_unit(2, "MB")} else {_unit(3, "GB")} end as size,
      case when n_chars * 4096 > 1073741824 then printf('%.2f GB', n_chars * 4096 / 1073741824.0::double)
        when n_chars * 4096 > 1048576 then printf('%.2f MB', n_chars * 4096 / 1048576.0::double)
        else printf('%.2f KB', n_chars * 4096 / 1024.0::double) end as file_size,
      true as is_label, true as is_csv, source || '.CSV' as base,
      format('{{:,}}', n_chars) as grouped, printf('%.4f', n_chars / 8.0::double) as fixed from documents""",
    "x_number_functions": """with e as (select *, event_id * 97 as s,
        make_timestamp((1700000000 + event_id * 61) * 1000000) as t from events)
      select event_id, round_even(event_id / 2.0::double, 0)::bigint as rounded,
        case when value > 20 then 20 when value < 1 then 1 else value end as clipped,
        round(value / greatest(event_id % 3, 1)::double, 6) as divided,
        strftime(t, '%Y-%m-%d %H:%M:%S') as moment, strftime(t, '%H:%M:%S') as clock,
        case when s >= 172800 then (s // 86400) || ' days, ' when s >= 86400 then '1 day, ' else '' end
          || printf('%d:%02d:%02d', s % 86400 // 3600, s % 3600 // 60, s % 60) as span,
        printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) as span_padded,
        printf('%dh %dm', s // 3600, s % 3600 // 60) as span_short,
        event_id || '.0' as canonical from e""",
    "x_nested_functions": """with e as (select *, (props->>'k')::bigint as kk, event_id % 5 as y0 from events)
      select event_id, kk as k, -1::bigint as absent, 1::bigint as entries, '{"k":' || kk || '}' as json,
        'k=' || kk as pairs, round(y0 + 2 * value, 6) as dot, round(value * y0, 6) as outer_2,
        round(1 + value + 2 * value * value, 6) as form, round((1 + value) / 2, 6) as mean,
        round(abs(value - 1) / 2, 6) as std, round(abs(value - 1) / (1 + value), 6) as cv from e""",
}
