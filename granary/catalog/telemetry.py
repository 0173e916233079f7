"""Run telemetry over the metrics that the events table provides."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.catalog.inputs import LEVEL, METRICS, metrics, r6
from granary.operators import bandit as B
from granary.operators import telemetry as I
from granary.session import written

WINDOW = 3600.0


def windowed(spark, sf):
    return I.rows_in_window(I.with_slices(metrics(spark, sf)), WINDOW)


def rows_in_window(spark, sf):
    return windowed(spark, sf).select("run_id", "seq", "window_rows")


def variation(spark, sf):
    return I.throughput_cv(metrics(spark, sf)).select("run_id", "seq", r6("cv").alias("cv"))


def widths(spark, sf):
    return I.adaptive_window(metrics(spark, sf)).select("run_id", "seq", "window_seconds")


def unreported_widths(spark, sf):
    """Samples without pressure report no throughput: their sample depends on the width."""
    calm = F.col("cpu_percent") < 30
    rows = metrics(spark, sf).withColumn("throughput", F.when(calm, 0.0).otherwise(F.col("throughput")))
    scaled = rows.withColumn("rows_processed", F.floor(F.col("rows_processed") / 250).cast("bigint"))
    return I.adaptive_window(scaled).select("run_id", "seq", "window_seconds")


def _context(spark, sf):
    return I.context_features(windowed(spark, sf), window_seconds=WINDOW / 10000)


CONTEXT = ["x_ram", "x_cpu", "x_rows", "x_workers", "x_chunk"]


def context(spark, sf):
    return _context(spark, sf).select("run_id", "seq", *[r6(c).alias(c) for c in CONTEXT])


def rewards(spark, sf):
    return I.reward(windowed(spark, sf)).select("run_id", "seq", r6("reward").alias("reward"))


def pressure(spark, sf):
    return I.classify_pressure(metrics(spark, sf)).select(
        "run_id", "seq", "level", "d_workers", "chunk_factor", "reason"
    )


def alerts(spark, sf):
    return I.memory_alerts(metrics(spark, sf)).select("run_id", "seq", "ram_percent")


def ticks(spark, sf):
    return I.tick_throughput(metrics(spark, sf)).select(
        "run_id", "seq", r6("rows_per_second").alias("rows_per_second")
    )


def intervals(spark, sf):
    rows = I.interval_throughput(metrics(spark, sf), 3600)
    return rows.select(
        "run_id",
        F.unix_seconds("interval_start").alias("interval_start"),
        "rows",
        r6("rows_per_second").alias("rows_per_second"),
    )


def peaks(spark, sf):
    return I.running_peaks(metrics(spark, sf)).select("run_id", "seq", "ram_peak", "cpu_peak")


def totals(spark, sf):
    rows = I.running_totals(metrics(spark, sf), F.col("cpu_percent") >= 50)
    return rows.select(
        "run_id", "seq", "rows_seen", "files_done", r6("elapsed").alias("elapsed"),
        r6("rows_per_second").alias("rows_per_second"),
    )


def _acted(df):
    """A logged action for every sample without pressure."""
    return df.withColumn(
        "action",
        F.when(I.pressure_level() == "normal", F.pmod(F.col("seq") * 5 + 3, F.lit(7))).cast("bigint"),
    )


def _statistics(context):
    return B.linucb_statistics(I.reward(_acted(context)), "action", CONTEXT, "reward")


def statistics(spark, sf):
    cells = _statistics(_context(spark, sf)).select("action", "n", F.posexplode(F.concat("a", "b")))
    return cells.select(
        "action", "n", F.col("pos").cast("bigint").alias("cell"), F.round("col", 4).alias("value")
    )


def scores(spark, sf):
    context = written(_context(spark, sf), "context")  # for the statistics and the scores
    scored = B.linucb_scores(context, _statistics(context), CONTEXT)
    return scored.select("run_id", "seq", "best_action", r6("best_score").alias("best_score"))


def last_actions(spark, sf):
    return I.last_active_action(_acted(metrics(spark, sf))).select("run_id", "seq", "rewarded_action")


def remaining(spark, sf):
    progress = I.running_totals(metrics(spark, sf)).withColumn("total", F.lit(5000))
    out = I.eta(progress, "elapsed", "files_done", "total", "ts")
    return out.select(
        "run_id",
        "seq",
        F.round("remaining_seconds", 3).alias("remaining_seconds"),
        F.unix_seconds("expected_end").alias("expected_end"),
    )


QUERIES = {
    "i1_rows_in_window": rows_in_window,
    "i2_throughput_cv": variation,
    "i3_adaptive_window": widths,
    "i3_adaptive_window_unreported": unreported_widths,
    "i4_context_features": context,
    "i5_reward": rewards,
    "i6_classify_pressure": pressure,
    "i6_memory_alerts": alerts,
    "i7_tick_throughput": ticks,
    "i7_interval_throughput": intervals,
    "i8_running_peaks": peaks,
    "i9_running_totals": totals,
    "i10_linucb_statistics": statistics,
    "i10_linucb_scores": scores,
    "i11_last_active_action": last_actions,
    "i12_eta": remaining,
}

_RUN = "partition by run_id order by ts, seq"
_W = f"""{METRICS}, w as (select *, sum(rows_processed) over (partition by run_id order by ts
    range between interval 3600 seconds preceding and current row)::bigint as window_rows from m)"""
_CV = """{m}, s as (select *, case when throughput > 0 then throughput else rows_processed / 5.0::double end as x
    from m),
  c as (select *, count(x) over f as k, avg(x) over f as mu, stddev_pop(x) over f as sd from s
    window f as (partition by run_id order by ts, seq rows between 7 preceding and current row)),
  cv as (select *, case when k >= 4 then case when mu > 0 then sd / mu else 0 end end as cv from c)"""
_CONTEXT = f"""{_W}, x as (select *, least(ram_percent / 100, 1) as x_ram, least(cpu_percent / 100, 1) as x_cpu,
    least(window_rows / greatest(0.36::double * 50000, 1), 1) as x_rows, num_workers / 12.0::double as x_workers,
    chunk_size / 750000.0::double as x_chunk from w)"""
_REWARD = f"""l as (select *, {LEVEL} as level from x),
  a as (select *, coalesce(max(case when level = 'normal' then 1 else 0 end) over (
    {_RUN} rows between unbounded preceding and 1 preceding), 0) as acted from l),
  p as (select *, case when coalesce(lag(acted) over ({_RUN}), 0) = 1
    then lag(window_rows) over ({_RUN})::double else 0 end as prev from a),
  rw as (select *, case when acted = 1 then (window_rows - prev) / greatest(prev + 1, 1)
    + case when ram_percent >= 90 then -2.0 when ram_percent >= 87 then -0.7 else 0 end
    + case when cpu_percent >= 98 then -1.5 when cpu_percent >= 95 then -0.8 else 0 end else 0 end as reward
    from p)"""
_ACTION = f"case when {LEVEL} = 'normal' then (seq * 5 + 3) % 7 end"
_CELLS = " union all ".join(
    [
        f"""select action, n, {5 * i + j}::bigint as cell, round(a{i}{j}, 4) as value from st"""
        for i in range(5)
        for j in range(5)
    ]
    + [f"select action, n, {25 + i}::bigint, round(b{i}, 4) from st" for i in range(5)]
)
_IDENTITY = "[" + ", ".join(
    "[" + ", ".join(f"a{i}{j}" for j in range(5)) + ", "
    + ", ".join("1.0" if j == i else "0.0" for j in range(5)) + "]::double[]"
    for i in range(5)
) + "]"
_XS = ["x_ram", "x_cpu", "x_rows", "x_workers", "x_chunk"]
_SUMS = ", ".join(
    [
        f"sum({a} * {b}) + {1.0 if i == j else 0.0} as a{i}{j}"
        for i, a in enumerate(_XS)
        for j, b in enumerate(_XS)
    ]
    + [f"sum(reward * {a}) as b{i}" for i, a in enumerate(_XS)]
)

ORACLES = {
    "i1_rows_in_window": f"""with {METRICS} select a.run_id, a.seq, sum(b.rows_processed)::bigint as window_rows
      from m a join m b on b.run_id = a.run_id and b.ts <= a.ts and b.ts >= a.ts - interval 3600 seconds
        and (b.ts, b.seq) <= (a.ts, a.seq) group by 1, 2""",
    "i2_throughput_cv": f"with {_CV.format(m=METRICS)} select run_id, seq, round(cv, 6) as cv from cv",
    "i3_adaptive_window": f"""with {_CV.format(m=METRICS)},
      d as (select *, case when cv < 0.15 then -0.5 when cv > 0.35 then 0.5 else 0 end::double as d from cv),
      l as (select run_id, seq, list(d) over ({_RUN} rows between unbounded preceding and current row) as ds from d)
      select run_id, seq, list_reduce(list_concat([5.0::double], ds),
        lambda w, d: least(12.0::double, greatest(3.0::double, w + d))) as window_seconds from l""",
    "i3_adaptive_window_unreported": f"""with recursive {METRICS},
      o as (select run_id, seq, row_number() over ({_RUN}) as i,
        case when cpu_percent < 30 then 0 else throughput end::double as tp,
        floor(rows_processed / 250)::bigint as rows from m),
      r as (
        select run_id, seq, i, 5.0::double as w, [case when tp > 0 then tp else rows / 5.0::double end] as xs
        from o where i = 1
        union all
        select run_id, seq, i, case when len(xs) < 4 then w
          when coalesce(list_stddev_pop(xs) / nullif(list_avg(xs), 0), 0) < 0.15 then greatest(3, w - 0.5)
          when coalesce(list_stddev_pop(xs) / nullif(list_avg(xs), 0), 0) > 0.35 then least(12, w + 0.5)
          else w end::double as w, xs
        from (select o.run_id, o.seq, o.i, r.w, list_concat(r.xs,
            [case when o.tp > 0 then o.tp else o.rows / greatest(0.5, r.w) end::double])[-8:] as xs
          from r join o on o.run_id = r.run_id and o.i = r.i + 1))
      select run_id, seq, w as window_seconds from r""",
    "i4_context_features": f"""with {_CONTEXT} select run_id, seq, {", ".join(
        f"round({c}, 6) as {c}" for c in _XS)} from x""",
    "i5_reward": f"""with {_CONTEXT}, {_REWARD} select run_id, seq, round(reward, 6) as reward from rw""",
    "i6_classify_pressure": f"""with {METRICS}, l as (select *, {LEVEL} as level from m)
      select run_id, seq, level,
        (greatest(1, least(12, num_workers + case level when 'GUARD RAM' then 1 - num_workers
          when 'normal' then 0 else -1 end)) - num_workers)::bigint as d_workers,
        case level when 'GUARD RAM' then 0.8 when 'NEAR RAM' then 0.95 when 'GUARD CPU' then 0.9
          else 1.0 end::double as chunk_factor,
        case level when 'GUARD RAM' then printf('GUARD: RAM %.1f%%', ram_percent)
          when 'NEAR RAM' then printf('NEAR: RAM %.1f%%', ram_percent)
          when 'GUARD CPU' then printf('GUARD: CPU %.1f%%', cpu_percent)
          else 'AI: dw=+0 chunk×=1.00' end as reason from l""",
    "i6_memory_alerts": f"with {METRICS} select run_id, seq, ram_percent from m where ram_percent >= 90",
    "i7_tick_throughput": f"""with {METRICS}, d as (select *,
        (epoch_us(ts) - lag(epoch_us(ts)) over ({_RUN})) / 1000000.0::double as dt from m)
      select run_id, seq, case when dt is not null
        then round(rows_processed / greatest(dt, 0.000001), 6) end as rows_per_second from d""",
    "i7_interval_throughput": f"""with {METRICS} select run_id,
      (epoch_us(ts) // 3600000000) * 3600 as interval_start, sum(rows_processed)::bigint as rows,
      round(sum(rows_processed) / 3600.0::double, 6) as rows_per_second from m group by 1, 2""",
    "i8_running_peaks": f"""with {METRICS} select run_id, seq, max(ram_percent) over w as ram_peak,
      max(cpu_percent) over w as cpu_peak from m window w as ({_RUN})""",
    "i9_running_totals": f"""with {METRICS}, t as (select run_id, seq, sum(rows_processed) over w::bigint as rows_seen,
        sum(case when cpu_percent >= 50 then 1 else 0 end) over w::bigint as files_done,
        (epoch_us(ts) - min(epoch_us(ts)) over (partition by run_id)) / 1000000.0::double as elapsed
        from m window w as ({_RUN}))
      select run_id, seq, rows_seen, files_done, round(elapsed, 6) as elapsed,
        round(rows_seen / greatest(elapsed, 0.001), 6) as rows_per_second from t""",
    "i10_linucb_statistics": f"""with {_CONTEXT}, {_REWARD},
      st as (select {_ACTION} as action, count(*) as n, {_SUMS} from rw where level = 'normal' group by 1)
      {_CELLS}""",
    "i10_linucb_scores": f"""with recursive {_CONTEXT}, {_REWARD},
      st as (select {_ACTION} as action, count(*) as n, {_SUMS} from rw where level = 'normal' group by 1),
      g as (
        select action, 1 as k, {_IDENTITY} as mat, [{", ".join(f"b{i}" for i in range(5))}]::double[] as b from st
        union all
        select action, k + 1, list_transform(range(1, 6), lambda i: case when i = k then p else
            list_transform(range(1, 11), lambda c: mat[i][c] - mat[i][k] * p[c]) end), b
        from (select *, list_transform(mat[k], lambda v: v / mat[k][k]) as p from g where k <= 5)),
      inv as (select action, list_transform(mat, lambda r: r[6:10]) as m, b from g where k = 6),
      v as (select run_id, seq, [x_ram, x_cpu, x_rows, x_workers, x_chunk]::double[] as x from x),
      sc as (select run_id, seq, action, list_inner_product(
            list_transform(m, lambda r: list_inner_product(r, b)), x)
          + 1.1 * sqrt(greatest(list_inner_product(
            list_transform(m, lambda r: list_inner_product(r, x)), x), 0)) as score from v, inv)
      select run_id, seq, action as best_action, round(score, 6) as best_score from sc
      qualify row_number() over (partition by run_id, seq order by score desc, action) = 1""",
    "i11_last_active_action": f"""with {METRICS}, a as (select *, {_ACTION} as action from m)
      select run_id, seq, last_value(action ignore nulls) over (
        {_RUN} rows between unbounded preceding and 1 preceding) as rewarded_action from a""",
    "i12_eta": f"""with {METRICS}, t as (select run_id, seq, ts, row_number() over ({_RUN}) as done,
        (epoch_us(ts) - min(epoch_us(ts)) over (partition by run_id)) / 1000000.0::double as elapsed from m),
      e as (select *, greatest(5000 - done, 0) * (elapsed / greatest(done, 1)) as rem from t)
      select run_id, seq, round(rem, 3) as remaining_seconds,
        ((epoch_us(ts) + floor(rem * 1000000)::bigint) // 1000000)::bigint as expected_end from e""",
}
