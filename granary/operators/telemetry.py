"""Computations over run metrics: one row per sample of a run.

Expected columns: ``run_id, ts (timestamp), seq, num_workers, chunk_size,
rows_processed, ram_percent, cpu_percent, throughput``; ``(ts, seq)`` is unique
within a run. A run may hold any share of all samples, so every window works on
(run, slice) and takes what lies ahead of its slice from a small summary.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.scalars import coefficient_of_variation, fixed_decimals
from granary.plans.slices import (
    PART,
    add_parts,
    add_slices,
    before,
    part_window,
    throughout,
    upto,
    with_carry,
)
from granary.plans.small import join_same_keys
from granary.session import written

RUN = "run_id"
ORDER = ("ts", "seq")

# Throughput window in seconds (start, bounds, step), its sample
# counts, and the variation below and above which it moves.
WINDOW_START, WINDOW_MIN, WINDOW_MAX, WINDOW_STEP = 5.0, 3.0, 12.0, 0.5
SAMPLES, SAMPLES_NEEDED = 8, 4
STEADY_BELOW, UNSTEADY_ABOVE = 0.15, 0.35
# Limits of a run and pressure thresholds in percent.
MAX_WORKERS, MAX_CHUNK, MAX_RAM = 12, 750_000, 90.0
NEAR_RAM_MARGIN, HIGH_CPU, NEAR_CPU = 3.0, 98.0, 95.0
ROWS_PER_SECOND_SCALE = 50_000.0
# Penalties in the reward.
RAM_PENALTY, NEAR_RAM_PENALTY = -2.0, -0.7
CPU_PENALTY, NEAR_CPU_PENALTY = -1.5, -0.8
# Fixed values: (change of workers, chunk factor) of the guard steps, and the factor's bounds.
GUARD_RAM_FACTOR, NEAR_RAM_FACTOR, GUARD_CPU_FACTOR = 0.80, 0.95, 0.90
FACTOR_MIN, FACTOR_MAX = 0.60, 1.40
# Memory alert threshold in percent.
ALERT_RAM = 90.0

MICROS = 1_000_000


def _micros(name: str = "ts") -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def _seconds(name: str = "ts") -> Column:
    return _micros(name) / F.lit(float(MICROS))


SLICE = "__run_slice"


def with_slices(df: DataFrame) -> DataFrame:
    """Cut a log once: the operators below keep the added column and reuse it.

    Without it each operator cuts its own input, which computes what lies before
    it once more to place the cuts. Worth it for chains of operators.
    """
    cut, names = add_slices(df, list(ORDER))
    return cut.withColumnRenamed(names[0], SLICE)


def _parted(df: DataFrame) -> DataFrame:
    if SLICE in df.columns:
        return add_parts(df, [RUN], slices=[SLICE])
    return add_parts(df, [RUN], list(ORDER))


def _along():
    return part_window(list(ORDER))


def _order_key() -> Column:
    return F.struct(*ORDER)


def rows_in_window(df: DataFrame, seconds: float = WINDOW_START, out: str = "window_rows") -> DataFrame:
    """Rows processed in the trailing window, both ends inclusive, in arrival order.

    Every sample adds its rows when it arrives and takes them back when it leaves
    the window, after the arrivals of that instant. The window's content is the
    running sum of these changes: linear work, however many samples it spans.
    """
    span = int(round(seconds * MICROS))
    arrivals = df.withColumn("__t", _micros()).withColumn("__leaves", F.lit(0)).withColumn(
        "__change", F.col("rows_processed").cast("bigint")
    )
    departures = df.select(
        RUN,
        (_micros() + F.lit(span)).alias("__t"),
        F.lit(1).alias("__leaves"),
        (-F.col("rows_processed")).cast("bigint").alias("__change"),
    )
    changes = arrivals.unionByName(departures, allowMissingColumns=True)
    order = ["__t", "__leaves", "seq"]
    parted = add_parts(changes, [RUN], order)
    here = F.sum("__change").over(upto(part_window(order)))
    carried = with_carry(
        parted.withColumn("__here", here),
        {"__sum": F.sum("__change")},
        {"__ahead": lambda w: F.coalesce(F.sum("__sum").over(before(w)), F.lit(0))},
    )
    content = (F.col("__here") + F.col("__ahead")).alias(out)
    return carried.where(F.col("__leaves") == 0).select(*df.columns, content)


def throughput_sample(window_seconds: Column | float = WINDOW_START) -> Column:
    """Reported throughput, or the rows over the window when none is reported."""
    width = F.lit(float(window_seconds)) if isinstance(window_seconds, (int, float)) else window_seconds
    rows = F.coalesce(F.col("rows_processed"), F.lit(0))
    return F.when(F.col("throughput") > 0, F.col("throughput")).otherwise(rows / F.greatest(F.lit(0.5), width))


def _variation(parted: DataFrame, value: str, out: str = "__cv") -> DataFrame:
    """Add the coefficient of variation of the last samples, NULL while they are too few.

    The samples before a row come from its own slice by position; the first rows
    of a slice take the missing ones from the tails of the slices before.
    """
    back = range(1, SAMPLES)
    near = [F.lag(value, k).over(_along()).alias(f"__lag{k}") for k in back]
    local = parted.select("*", F.row_number().over(_along()).alias("__place"), *near)
    newest_first = F.array_compact(F.array(value, *[F.col(f"__lag{k}") for k in back[:-1]]))
    carried = with_carry(
        local,
        {"__tail": F.max_by(newest_first, _order_key())},
        # Every earlier slice holds at least one sample, so that many slices suffice.
        {
            "__prior": lambda w: F.flatten(
                F.reverse(F.collect_list("__tail").over(w.rowsBetween(1 - SAMPLES, -1)))
            )
        },
    )
    values = [F.col(value)] + [
        F.when(F.col("__place") > k, F.col(f"__lag{k}")).otherwise(
            F.get("__prior", (F.lit(k) - F.col("__place")).cast("int"))
        )
        for k in back
    ]
    recent = carried.select(
        *parted.columns, *[v.alias(f"__v{k}") for k, v in enumerate(values)]
    )
    columns = [F.col(f"__v{k}") for k in range(SAMPLES)]

    def total(terms: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(0.0)) for t in terms])

    number = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in columns])
    counted = recent.select("*", number.alias("__n")).select(
        "*", (total(columns) / F.col("__n")).alias("__mean")
    )
    spread = total([(c - F.col("__mean")) * (c - F.col("__mean")) for c in columns])
    cv = coefficient_of_variation(F.col("__mean"), F.sqrt(spread / F.col("__n")))
    ready = F.when(F.col("__n") >= SAMPLES_NEEDED, cv)
    return counted.select(*parted.columns, ready.alias(out))


def throughput_cv(df: DataFrame, window_seconds: float = WINDOW_START, out: str = "cv") -> DataFrame:
    """Coefficient of variation of the last eight samples; NULL before the fourth."""
    sampled = df.withColumn("__sample", throughput_sample(window_seconds).cast("double"))
    return _variation(_parted(sampled), "__sample", out).select(*df.columns, out)


def next_width(width: float, samples: list[float]) -> float:
    """Window width after the newest of the last samples, by their variation."""
    n = len(samples)
    if n < SAMPLES_NEEDED:
        return width
    mean = sum(samples) / n
    cv = 0.0
    if mean > 0:
        cv = (sum((v - mean) * (v - mean) for v in samples) / n) ** 0.5 / mean
    return moved(width, -WINDOW_STEP if cv < STEADY_BELOW else WINDOW_STEP if cv > UNSTEADY_ABOVE else 0.0)


def moved(width: float, step: float) -> float:
    return min(WINDOW_MAX, max(WINDOW_MIN, width + step))


def _known_steps(values: np.ndarray) -> np.ndarray:
    """Step after each value from the last eight values; NaN where one of them is NaN (not known yet)."""
    absent = np.full(SAMPLES - 1, np.inf)
    last = np.lib.stride_tricks.sliding_window_view(np.concatenate([absent, values]), SAMPLES)
    there = ~np.isinf(last)
    n = there.sum(axis=1)
    held = np.where(there, last, 0.0)
    mean = held.sum(axis=1) / np.maximum(n, 1)
    spread = np.sqrt((np.where(there, held - mean[:, None], 0.0) ** 2).sum(axis=1) / np.maximum(n, 1))
    cv = np.divide(spread, mean, out=np.zeros_like(mean), where=mean > 0)
    steps = np.where(cv < STEADY_BELOW, -WINDOW_STEP, np.where(cv > UNSTEADY_ABOVE, WINDOW_STEP, 0.0))
    steps[n < SAMPLES_NEEDED] = 0.0
    steps[np.isnan(held).any(axis=1)] = np.nan
    return steps


GRID = [WINDOW_MIN + WINDOW_STEP * k for k in range(int((WINDOW_MAX - WINDOW_MIN) / WINDOW_STEP) + 1)]
#: A state as one number: in its last digit the width's place on the grid, and in the k-th one before
#: it the place, plus 1, of the width with which the k-th last sample was taken, 0 if none was used.
DIGITS = len(GRID) + 1
START_STATE = GRID.index(WINDOW_START)
#: Rows of a run that one task follows, at most about twice as many.
PIECE_ROWS = 50_000


def _opened(state: int) -> tuple[float, tuple]:
    """Width, and (place before the next sample, width) of the last samples that used one."""
    width, own = GRID[state % DIGITS], []
    for k in range(1, SAMPLES):
        state //= DIGITS
        if state % DIGITS:
            own.append((-k, GRID[state % DIGITS - 1]))
    return width, tuple(reversed(own))


def _closed(width: float, own: tuple, samples: int) -> int:
    state = GRID.index(width)
    for place, used in own:
        if samples - place < SAMPLES:
            state += (GRID.index(used) + 1) * DIGITS ** (samples - place)
    return state


def possible_states(head: list[float]) -> list[int]:
    """All states behind samples ``head``, NaN for one that used a width: widths move by a step at most."""
    states = {(k, k) for k in range(len(GRID))}
    for ago, value in enumerate(reversed(head), 1):
        digit = DIGITS**ago if value != value else 0
        states = {
            (state + (near + 1) * digit, near)
            for state, k in states
            for near in range(max(0, k - 1), min(len(GRID), k + 2))
        }
    return sorted({state for state, _ in states})


def _clamped(steps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Widths after each of these known steps from the first start, and at the end from every start.

    A step adds and cuts off at both bounds, and so do any steps in a row: they are put together by doubling.
    """
    add, low, high = steps.copy(), np.full(len(steps), WINDOW_MIN), np.full(len(steps), WINDOW_MAX)
    far = 1
    while far < len(steps):
        own, least, most = add[far:].copy(), low[far:].copy(), high[far:].copy()
        low[far:], high[far:] = (np.clip(bound[:-far] + own, least, most) for bound in (low, high))
        add[far:] = add[:-far] + own
        far *= 2
    return np.clip(starts[0] + add, low, high), np.clip(starts + add[-1], low[-1], high[-1])


def _walk(pdf: pd.DataFrame, starts: list[int]) -> tuple[list[int], np.ndarray]:
    """Follows a stretch of a run, its rows in order, from several states at once.

    Returns the state at the end for each start, and the width after each sample
    for the first start. Starts that come to the same state go on as one. Only
    samples at which the width can move are visited.
    """
    head, head_rows = (list(v) if v is not None else [] for v in (pdf["head"].iat[0], pdf["head_rows"].iat[0]))
    rows, reported = pdf["rows_processed"].to_numpy(np.float64), pdf["throughput"].to_numpy(np.float64)
    depends = ~(reported > 0) & (rows > 0)
    values = np.where(reported > 0, reported, np.where(depends, np.nan, 0.0))
    known = np.concatenate([head, values])
    of_place = np.concatenate([head_rows, rows])
    steps = _known_steps(known)[len(head) :]
    if not depends.any() and not np.isnan(steps).any():
        opened = [_opened(state) for state in starts]
        after = _clamped(steps, np.array([width for width, _ in opened]))
        return [_closed(width, own, len(pdf)) for width, (_, own) in zip(after[1].tolist(), opened, strict=True)], after[0]
    visits = np.flatnonzero(depends | np.isnan(steps) | (steps != 0))
    states: dict[tuple, list[int]] = {}
    for k, state in enumerate(starts):
        states.setdefault(_opened(state), []).append(k)
    trace = np.empty(len(visits) + 1)
    trace[0] = _opened(starts[0])[0]
    for nth, i in enumerate(visits.tolist(), 1):
        after: dict[tuple, list[int]] = {}
        for (width, own), members in states.items():
            own = tuple(x for x in own if x[0] > i - SAMPLES)
            if depends[i]:
                own += ((i, width),)
            if not np.isnan(steps[i]):
                width = moved(width, steps[i])
            else:
                at = i + len(head)
                last = known[max(0, at - SAMPLES + 1) : at + 1].copy()
                for place, used in own:
                    last[place - i - 1] = of_place[place + len(head)] / max(0.5, used)
                width = next_width(width, last.tolist())
            after.setdefault((width, own), []).extend(members)
            if 0 in members:
                trace[nth] = width
        states = after
    ends = [0] * len(starts)
    for (width, own), members in states.items():
        state = _closed(width, own, len(pdf))
        for k in members:
            ends[k] = state
    place = np.zeros(len(pdf), dtype=int)
    place[visits] = 1
    return ends, trace[np.cumsum(place)]


def _samples(df: DataFrame) -> DataFrame:
    return df.select(
        RUN,
        *ORDER,
        F.col("throughput").cast("double").alias("throughput"),
        F.coalesce(F.col("rows_processed").cast("double"), F.lit(0.0)).alias("rows_processed"),
    )


def _sample() -> Column:
    """What a sample counts in the variation; NaN if the width decides."""
    reported = F.coalesce(F.col("throughput") > 0, F.lit(False))
    return F.when(reported, F.col("throughput")).when(F.col("rows_processed") > 0, float("nan")).otherwise(F.lit(0.0))


def _stretches(df: DataFrame, piece_rows: int) -> DataFrame:
    """``run_id, ts, seq, throughput, rows_processed, unit, head, head_rows``: runs cut into stretches.

    Of every ``piece_rows`` rows of a slice the first is a cut behind which the seven samples before do not
    depend on the width: there the width alone is the state. Where there is none, it is the first with seven
    samples before it. ``head`` holds these samples in the first row of a stretch, ``head_rows`` their rows.
    """
    work, slices = add_slices(_samples(df), list(ORDER))
    parted = add_parts(work, [RUN], slices=slices).withColumn("__slice", F.col(slices[0]))
    back = _along().rowsBetween(1 - SAMPLES, -1)
    local = parted.select(
        "*",
        F.expr(f"(row_number() over (partition by {PART} order by {', '.join(ORDER)}) - 1) div {piece_rows}").alias("__piece"),
        F.collect_list(_sample()).over(back).alias("__head"),
        F.collect_list("rows_processed").over(back).alias("__head_rows"),
    )
    full = F.size("__head") == SAMPLES - 1
    free = full & ~F.exists("__head", F.isnan)
    here = Window.partitionBy(PART, "__piece")
    cut = F.coalesce(F.min(F.when(free, _order_key())).over(here), F.min(F.when(full, _order_key())).over(here))
    placed = local.withColumns({"__cut": cut, "__unit": F.col("__slice").cast("long") * (1 << 20) + F.col("__piece")})
    carried = with_carry(
        placed,
        {"__last": F.max(F.when(F.col("__cut").isNotNull(), F.col("__unit")))},
        {"__prior": lambda w: F.max("__last").over(before(w))},
    )
    behind = F.coalesce(_order_key() >= F.col("__cut"), F.lit(False))
    first = _order_key() == F.col("__cut")
    return carried.select(
        RUN,
        *ORDER,
        "throughput",
        "rows_processed",
        F.when(behind, F.col("__unit"))
        .when(F.col("__piece") > 0, F.col("__unit") - 1)
        .otherwise(F.coalesce("__prior", F.lit(-1).cast("long")))
        .alias("unit"),
        F.when(first, F.col("__head")).alias("head"),
        F.when(first, F.col("__head_rows")).alias("head_rows"),
    )


def adaptive_window(df: DataFrame, out: str = "window_seconds", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Width of the throughput window after each sample.

    The width shrinks by a step while the last samples are steady and grows while
    they are not; a sample without reported throughput depends on the width before
    it. A state is the width and the widths that the last seven samples used. Each
    stretch of a run is followed from all states that can stand before it, which soon
    become few; one that can begin in many is followed again from those alone in which
    the stretch before it can end. The ends are chained per run, one row per stretch, and
    every stretch is replayed from its own entry: four passes, whatever the number of
    stretches, none of which has more than about twice ``piece_rows`` rows. NULL throughput
    is not reported, NULL rows are none, NULL runs are one run.
    """
    widths, _ = followed_widths(df, piece_rows=piece_rows)
    return join_same_keys(df, widths.select(RUN, *ORDER, F.col("after").alias(out)), [RUN, *ORDER])


def _in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(list(ORDER))


def followed_widths(df: DataFrame, carried: DataFrame | None = None, piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(run_id, ts, seq, after) of all samples, and (run_id, state, head, head_rows) behind the last one of each run.

    ``carried`` holds the latter from an earlier call whose samples lie before these; other runs start anew.
    """
    rows = _stretches(df, piece_rows)
    start = F.lit(START_STATE).cast("long")
    if carried is None:
        rows = rows.withColumn("state", start)
    else:
        known = carried.select(RUN, "state", F.col("head").alias("__head"), F.col("head_rows").alias("__head_rows"))
        first = F.col("unit") == -1
        rows = join_same_keys(rows, known, [RUN], "left").withColumns(
            {
                "head": F.when(first, F.col("__head")).otherwise(F.col("head")),
                "head_rows": F.when(first, F.col("__head_rows")).otherwise(F.col("head_rows")),
                "state": F.coalesce("state", start),
            }
        ).drop("__head", "__head_rows")
    rows = written(rows, "stretches")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    keys = f"`{RUN}` {kinds[RUN]}, unit long"

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _in_order(pdf)
        head = pdf["head"].iat[0]
        starts = [int(pdf["state"].iat[0])] if pdf["unit"].iat[0] == -1 else possible_states([] if head is None else list(head))
        found = _walk(pdf, starts)[0]
        many = len(starts) > len(GRID)
        table = {"entries": [[] if many else starts], "ends": [sorted(set(found)) if many else found]}
        return pdf.iloc[[0]][[RUN, "unit"]].assign(many=many, **table)

    def few_ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _in_order(pdf)
        starts = [int(x) for x in pdf["entries"].iat[0]]
        return pdf.iloc[[0]][[RUN, "unit"]].assign(entries=[starts], ends=[_walk(pdf, starts)[0]])

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _in_order(pdf)
        return pdf[[RUN, *ORDER]].assign(after=_walk(pdf, [int(pdf["entry"].iat[0])])[1])

    shape = f"{keys}, entries array<bigint>, ends array<bigint>"
    units = rows.groupBy(RUN, "unit").applyInPandas(ends, f"{keys}, many boolean, entries array<bigint>, ends array<bigint>")
    units = written(units, "stretch-ends")
    ahead = F.lag("ends").over(Window.partitionBy(RUN).orderBy("unit"))
    many = units.withColumn("entries", F.array_distinct(ahead)).where("many").select(RUN, "unit", "entries")
    again = join_same_keys(rows, many, [RUN, "unit"]).groupBy(RUN, "unit").applyInPandas(few_ends, shape)
    units = written(units.where("not many").drop("many").unionByName(again), "stretch-tables")
    chain = "array<struct<unit:bigint,entry:bigint>>"
    begin = F.struct(F.lit(None).cast("long").alias("state"), F.array().cast(chain).alias("entries"))

    def onward(at: Column, u: Column) -> Column:
        # The first stretch of a run has one entry, where the run stands.
        entry = F.coalesce(at["state"], F.get(u["entries"], F.lit(0)))
        end = F.element_at(F.map_from_arrays(u["entries"], u["ends"]), entry)
        return F.struct(end.alias("state"), F.concat(at["entries"], F.array(F.struct(u["unit"].alias("unit"), entry.alias("entry")))).alias("entries"))

    chained = F.aggregate(F.sort_array(F.collect_list(F.struct("unit", "entries", "ends"))), begin, onward)
    runs = written(units.groupBy(RUN).agg(chained.alias("c")).select(RUN, "c.*"), "run-entries")
    entered = join_same_keys(rows, runs.select(RUN, F.inline("entries")), [RUN, "unit"])
    order = ", ".join(f"`{c}` {kinds[c]}" for c in (RUN, *ORDER))
    widths = entered.groupBy(RUN, "unit").applyInPandas(replay, f"{order}, after double")
    newest = Window.partitionBy(RUN).orderBy(*[F.desc(c) for c in ORDER])
    last = rows.withColumn("__ago", F.row_number().over(newest)).where(F.col("__ago") < SAMPLES)
    last = last.groupBy(RUN).agg(F.sort_array(F.collect_list(F.struct((-F.col("__ago")).alias("at"), _sample().alias("v"), "rows_processed"))).alias("t"))
    heads = last.select(RUN, F.col("t.v").alias("head"), F.col("t.rows_processed").alias("head_rows"))
    states = join_same_keys(runs.select(RUN, "state"), heads, [RUN])
    if carried is not None:
        both = join_same_keys(states, known.drop("state"), [RUN], "left")
        longer = lambda name: F.concat(F.coalesce(f"__{name}", F.array().cast("array<double>")), F.col(name))
        cut = lambda name: F.slice(longer(name), F.greatest(F.size(longer(name)) - SAMPLES + 2, F.lit(1)), F.lit(SAMPLES - 1))
        states = both.select(RUN, "state", cut("head").alias("head"), cut("head_rows").alias("head_rows"))
    return widths, states


def context_features(
    df: DataFrame,
    max_workers: int = MAX_WORKERS,
    max_chunk: int = MAX_CHUNK,
    window_rows: str = "window_rows",
    window_seconds: str | float = WINDOW_START,
) -> DataFrame:
    """Five ratios that describe a sample: memory, CPU, rows, workers, chunk size."""
    width = F.col(window_seconds) if isinstance(window_seconds, str) else F.lit(float(window_seconds))
    one = F.lit(1.0)
    scale = F.greatest(width * ROWS_PER_SECOND_SCALE, one)
    return df.select(
        "*",
        F.least(F.col("ram_percent") / 100.0, one).alias("x_ram"),
        F.least(F.col("cpu_percent") / 100.0, one).alias("x_cpu"),
        F.least(F.col(window_rows) / scale, one).alias("x_rows"),
        (F.col("num_workers") / F.lit(float(max(max_workers, 1)))).alias("x_workers"),
        (F.col("chunk_size") / F.lit(float(max(max_chunk, 1)))).alias("x_chunk"),
    )


def pressure_level(max_ram: float = MAX_RAM) -> Column:
    return (
        F.when(F.col("ram_percent") >= max_ram, "GUARD RAM")
        .when(F.col("ram_percent") >= max_ram - NEAR_RAM_MARGIN, "NEAR RAM")
        .when(F.col("cpu_percent") >= HIGH_CPU, "GUARD CPU")
        .otherwise("normal")
    )


def classify_pressure(
    df: DataFrame,
    max_ram: float = MAX_RAM,
    max_workers: int = MAX_WORKERS,
    action_workers: Column | None = None,
    action_factor: Column | None = None,
) -> DataFrame:
    """Pressure level of a sample with the bounded change of workers, chunk factor and reason.

    Under no pressure the logged action applies (none by default).
    """
    level = F.col("level")
    workers = F.col("num_workers")
    wanted = (
        F.when(level == "GUARD RAM", 1 - workers)
        .when(level.isin("NEAR RAM", "GUARD CPU"), F.lit(-1))
        .otherwise(F.lit(0) if action_workers is None else action_workers)
    )
    factor = (
        F.when(level == "GUARD RAM", GUARD_RAM_FACTOR)
        .when(level == "NEAR RAM", NEAR_RAM_FACTOR)
        .when(level == "GUARD CPU", GUARD_CPU_FACTOR)
        .otherwise(F.lit(1.0) if action_factor is None else action_factor)
    )
    new_workers = F.greatest(F.lit(1), F.least(F.lit(max_workers), workers + wanted))
    percent = fixed_decimals(F.when(level == "GUARD CPU", F.col("cpu_percent")).otherwise(F.col("ram_percent")), 1)
    parts = F.split(level, " ")
    reason = F.when(
        level == "normal",
        F.concat(F.format_string("AI: dw=%+d chunk×=", wanted.cast("bigint")), fixed_decimals(factor, 2)),
    ).otherwise(
        F.concat(F.get(parts, F.lit(0)), F.lit(": "), F.get(parts, F.lit(1)), F.lit(" "), percent, F.lit("%"))
    )
    return df.withColumn("level", pressure_level(max_ram)).select(
        "*",
        (new_workers - workers).cast("bigint").alias("d_workers"),
        F.greatest(F.lit(FACTOR_MIN), F.least(F.lit(FACTOR_MAX), factor)).alias("chunk_factor"),
        reason.alias("reason"),
    )


def memory_alerts(df: DataFrame, threshold: float = ALERT_RAM) -> DataFrame:
    """Samples at or above the memory alert threshold."""
    return df.where(F.col("ram_percent") >= threshold)


def reward(
    df: DataFrame, score: str = "window_rows", max_ram: float = MAX_RAM, out: str = "reward"
) -> DataFrame:
    """Relative gain of the score since the last rewarded sample, minus pressure penalties.

    0 until the run had a sample without pressure, since only those take an action.
    """
    key = _order_key()
    calm = pressure_level(max_ram) == "normal"
    current = F.struct(*ORDER, F.col(score).cast("double").alias("s"))
    local = _parted(df).withColumn("__lag", F.lag(current).over(_along()))
    carried = with_carry(
        local,
        {"__last": F.max_by(current, key), "__calm": F.min(F.when(calm, key))},
        {
            "__carry": lambda w: F.lag("__last").over(w),
            "__first_calm": lambda w: F.min("__calm").over(throughout(w)),
        },
    )
    previous = F.coalesce("__lag", "__carry")
    acted = F.coalesce(key > F.col("__first_calm"), F.lit(False))
    previous_acted = F.coalesce(
        F.struct(*[F.col(f"__previous.{c}").alias(c) for c in ORDER]) > F.col("__first_calm"),
        F.lit(False),
    )
    base = F.when(previous_acted, F.col("__previous.s")).otherwise(F.lit(0.0))
    gain = (F.col(score) - base) / F.greatest(base + 1.0, F.lit(1.0))
    ram, cpu = F.col("ram_percent"), F.col("cpu_percent")
    penalty = F.when(ram >= max_ram, RAM_PENALTY).when(
        ram >= max_ram - NEAR_RAM_MARGIN, NEAR_RAM_PENALTY
    ).otherwise(0.0) + F.when(cpu >= HIGH_CPU, CPU_PENALTY).when(
        cpu >= NEAR_CPU, NEAR_CPU_PENALTY
    ).otherwise(0.0)
    return carried.withColumn("__previous", previous).select(
        *df.columns, F.when(acted, gain + penalty).otherwise(F.lit(0.0)).alias(out)
    )


def tick_throughput(df: DataFrame, out: str = "rows_per_second") -> DataFrame:
    """Rows of a sample over the time since the sample before; NULL for the first one."""
    local = _parted(df).withColumn("__lag", F.lag(_micros()).over(_along()))
    carried = with_carry(
        local, {"__last": F.max(_micros())}, {"__carry": lambda w: F.lag("__last").over(w)}
    )
    previous = F.coalesce("__lag", "__carry")
    elapsed = F.greatest((_micros() - previous) / float(MICROS), F.lit(1e-6))
    rate = F.when(previous.isNotNull(), F.col("rows_processed") / elapsed)
    return carried.withColumn(out, rate).select(*df.columns, out)


def interval_throughput(df: DataFrame, seconds: int = 5) -> DataFrame:
    """Rows and rows per second in tumbling intervals of a run."""
    span = F.window(F.col("ts").cast("timestamp"), f"{seconds} seconds")
    rows = df.groupBy(RUN, span.alias("w")).agg(F.sum("rows_processed").alias("rows"))
    return rows.select(
        RUN,
        F.col("w.start").alias("interval_start"),
        F.col("rows").cast("bigint").alias("rows"),
        (F.col("rows") / F.lit(float(seconds))).alias("rows_per_second"),
    )


def running_peaks(df: DataFrame) -> DataFrame:
    """Highest memory and CPU use of a run so far."""
    local = (
        _parted(df)
        .withColumn("__ram_here", F.max("ram_percent").over(upto(_along())))
        .withColumn("__cpu_here", F.max("cpu_percent").over(upto(_along())))
    )
    carried = with_carry(
        local,
        {"__ram": F.max("ram_percent"), "__cpu": F.max("cpu_percent")},
        {
            "__ram_ahead": lambda w: F.max("__ram").over(before(w)),
            "__cpu_ahead": lambda w: F.max("__cpu").over(before(w)),
        },
    )
    return carried.select(
        *df.columns,
        F.greatest("__ram_here", "__ram_ahead").alias("ram_peak"),
        F.greatest("__cpu_here", "__cpu_ahead").alias("cpu_peak"),
    )


def running_totals(df: DataFrame, file_done: Column | None = None) -> DataFrame:
    """Rows and finished files so far, time since the run's first sample, rows per second."""
    flag = F.lit(1) if file_done is None else F.when(file_done, 1).otherwise(0)
    local = (
        _parted(df.withColumn("__done", flag))
        .withColumn("__rows_here", F.sum("rows_processed").over(upto(_along())))
        .withColumn("__files_here", F.sum("__done").over(upto(_along())))
    )
    carried = with_carry(
        local,
        {"__rows": F.sum("rows_processed"), "__files": F.sum("__done"), "__start": F.min(_micros())},
        {
            "__rows_ahead": lambda w: F.coalesce(F.sum("__rows").over(before(w)), F.lit(0)),
            "__files_ahead": lambda w: F.coalesce(F.sum("__files").over(before(w)), F.lit(0)),
            "__begin": lambda w: F.min("__start").over(upto(w)),
        },
    )
    rows = F.col("__rows_here") + F.col("__rows_ahead")
    elapsed = (_micros() - F.col("__begin")) / float(MICROS)
    return carried.select(
        *df.columns,
        rows.cast("bigint").alias("rows_seen"),
        (F.col("__files_here") + F.col("__files_ahead")).cast("bigint").alias("files_done"),
        elapsed.alias("elapsed"),
        (rows / F.greatest(elapsed, F.lit(1e-3))).alias("rows_per_second"),
    )


def last_active_action(df: DataFrame, action: str = "action", out: str = "rewarded_action") -> DataFrame:
    """The latest action a run took before the sample; guard steps (NULL) take none."""
    near = F.last(action, ignorenulls=True).over(before(_along()))
    carried = with_carry(
        _parted(df).withColumn("__near", near),
        {"__last": F.max_by(action, F.when(F.col(action).isNotNull(), _order_key()))},
        {"__carry": lambda w: F.last("__last", ignorenulls=True).over(before(w))},
    )
    return carried.select(*df.columns, F.coalesce("__near", "__carry").alias(out))


def eta(df: DataFrame, elapsed: str, done: str, total: str, now: str | None = None) -> DataFrame:
    """Remaining seconds at the pace so far, and the expected end when ``now`` is given."""
    pace = F.col(elapsed) / F.greatest(F.col(done), F.lit(1))
    remaining = F.greatest(F.col(total) - F.col(done), F.lit(0)) * pace
    out = df.withColumn("remaining_seconds", remaining)
    if now is None:
        return out
    end = F.timestamp_micros(_micros(now) + F.floor(F.col("remaining_seconds") * MICROS).cast("bigint"))
    return out.withColumn("expected_end", end)
