import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import bandit as B
from granary.operators import telemetry as I

SCHEMA = (
    "run_id string, ts timestamp, seq bigint, num_workers bigint, chunk_size bigint, "
    "rows_processed bigint, ram_percent double, cpu_percent double, throughput double"
)
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def sample(run, second, seq, rows=1, ram=50.0, cpu=50.0, tp=0.0, workers=4):
    return (run, START + dt.timedelta(seconds=second), seq, workers, 50_000, rows, ram, cpu, tp)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def ordered(df, column):
    return [r[column] for r in df.orderBy("run_id", "ts", "seq").collect()]


def test_trailing_window_is_inclusive(spark):
    df = frame(spark, [sample("a", 0, 0), sample("a", 5, 1), sample("a", 5.1, 2)])
    assert ordered(I.rows_in_window(df), "window_rows") == [1, 2, 2]


def test_trailing_window_in_arrival_order_across_slices(spark):
    rng = random.Random(3)
    rows = [sample("a", rng.randrange(60), i, rows=i) for i in range(300)]
    got = {r["seq"]: r["window_rows"] for r in I.rows_in_window(frame(spark, rows)).collect()}
    for _, ts, seq, *_rest in rows:
        inside = [
            r for r in rows
            if (ts - r[1]).total_seconds() <= 5 and (r[1], r[2]) <= (ts, seq)
        ]
        assert got[seq] == sum(r[5] for r in inside)


@pytest.mark.parametrize("ram, cpu, gain", [(50, 50, 1.0), (90, 95, -1.8), (87, 98, -1.2)])
def test_reward(spark, ram, cpu, gain):
    rows = [
        sample("a", 0, 0), sample("a", 1, 1, rows=10), sample("a", 2, 2, rows=21, ram=float(ram), cpu=float(cpu)),
    ]
    df = frame(spark, rows).withColumn("window_rows", F.col("rows_processed"))
    rewards = ordered(I.reward(df), "reward")
    assert rewards[0] == 0.0 and rewards[1] == 10.0
    assert rewards[2] == pytest.approx(gain)


def test_pressure_rules(spark):
    cases = [(90, 50), (87, 50), (50, 98), (50, 50)]
    df = frame(spark, [sample("a", i, i, ram=float(r), cpu=float(c)) for i, (r, c) in enumerate(cases)])
    out = I.classify_pressure(df).orderBy("seq").collect()
    assert [r["level"] for r in out] == ["GUARD RAM", "NEAR RAM", "GUARD CPU", "normal"]
    assert [r["d_workers"] for r in out] == [-3, -1, -1, 0]
    assert [r["chunk_factor"] for r in out] == [0.80, 0.95, 0.90, 1.0]
    assert [r["reason"] for r in out][:3] == ["GUARD: RAM 90.0%", "NEAR: RAM 87.0%", "GUARD: CPU 98.0%"]


def controller(rows):
    """Sample by sample: window width and variation."""
    width, samples, out = 5.0, [], []
    for _, _ts, seq, _w, _c, n, _ram, _cpu, tp in rows:
        samples = [*samples, tp if tp > 0 else n / max(0.5, width)][-8:]
        cv = None
        if len(samples) >= 4:
            mean, std = np.mean(samples), np.std(samples)
            cv = std / mean if mean > 0 else 0.0
            if cv < 0.15:
                width = max(3.0, width - 0.5)
            elif cv > 0.35:
                width = min(12.0, width + 0.5)
        out.append((seq, width, cv))
    return out


@pytest.mark.parametrize("reported", [True, False])
def test_adaptive_window_is_the_sequential_rule(spark, reported):
    rng = random.Random(7)
    rows = []
    for run in ("hot", "cold"):
        for i in range(400 if run == "hot" else 30):
            steady = (i // 40) % 2
            n = 1000 if steady else rng.randrange(1, 3000)
            tp = float(n) if reported or rng.random() < 0.3 else 0.0
            rows.append(sample(run, i, i, rows=n * (1 if tp else 8), tp=tp))
    df = frame(spark, rows)
    for run in ("hot", "cold"):
        mine = [r for r in rows if r[0] == run]
        got = I.adaptive_window(df).where(F.col("run_id") == run)
        assert ordered(got, "window_seconds") == [w for _, w, _cv in controller(mine)]
    assert len({w for _, w, _cv in controller([r for r in rows if r[0] == "hot"])}) > 5


def odd_log(kind, n=500):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        n, tp = rng.randrange(1, 3000), float(rng.randrange(500, 1500))
        if kind == "null throughput":
            tp = None if rng.random() < 0.5 else tp
        elif kind == "level":  # neither steady nor unsteady: the width stays what it was
            n, tp = (1000, 0.0) if i < 20 else (0, 1000.0 * (1 + (i % 2) * 0.6))
        elif kind == "rare reports":
            tp = tp if rng.random() < 0.1 else 0.0
        elif kind == "never":
            tp = 0.0
        rows.append(sample(None if kind == "null run" and i % 2 else "a", i, i, rows=n, tp=tp))
    return rows


def by_rule(rows):
    return {seq: w for seq, w, _cv in controller([(*r[:8], r[8] or 0.0) for r in rows])}


@pytest.mark.parametrize("piece", [16, I.PIECE_ROWS])
@pytest.mark.parametrize("kind", ["null run", "null throughput", "level", "rare reports", "never"])
def test_adaptive_window_odd_logs(spark, kind, piece):
    """Logs whose runs, throughput or steps are odd, in many slices and pieces, against the sequential rule."""
    rows = odd_log(kind, 500 if piece > 16 else 140)
    got = {r["seq"]: r["window_seconds"] for r in I.adaptive_window(frame(spark, rows), piece_rows=piece).collect()}
    assert len(got) == len(rows)
    for run in {r[0] for r in rows}:
        mine = [(*r[:8], r[8] or 0.0) for r in rows if r[0] == run]
        assert [got[r[2]] for r in mine] == [w for _, w, _cv in controller(mine)]


def test_no_stretch_is_longer_than_two_pieces(spark):
    """A run with most of the log that never reports, beside one that does."""
    rows = odd_log("never", 900) + [sample("b", i, i, rows=5, tp=float(i % 7 + 1)) for i in range(100)]
    cut = I._stretches(frame(spark, rows), 32)
    assert cut.groupBy("run_id", "unit").count().agg(F.max("count")).first()[0] <= 64 + 8
    heads = cut.where("head is not null").select(F.size("head").alias("n")).distinct().collect()
    assert [r.n for r in heads] == [7]


def test_states_hold_the_widths_that_samples_used():
    rng = random.Random(5)
    free = [1.0] * 7
    assert I.possible_states(free) == list(range(19)) == I.possible_states([])
    for _ in range(200):
        width, own = 5.0, ()
        for i in range(30):
            if rng.random() < 0.6:
                own = (*own, (i, width))
            width = I.moved(width, rng.choice([-0.5, 0.0, 0.5]))
        state = I._closed(width, own, 30)
        again, used = I._opened(state)
        assert again == width and [(30 + p, w) for p, w in used] == [x for x in own if x[0] > 22]
        head = [float("nan") if any(p == i for p, _ in own) else 1.0 for i in range(23, 30)]
        assert state in I.possible_states(head)


@pytest.mark.parametrize("kind", ["never", "rare reports", "null throughput"])
def test_widths_go_on_from_carried_states(spark, kind):
    """A log in parts, each from the states behind the one before; one run begins late, one ends early."""
    rows = odd_log(kind, 120) + [sample("late", i, i, rows=900, tp=0.0) for i in range(100, 120)]
    rows += [sample("early", i, i, rows=40 * (i % 5), tp=0.0) for i in range(3)]
    got, carried = {}, None
    for low, high in ((0, 3), (3, 60), (60, 61), (61, 120)):
        part = frame(spark, [r for r in rows if low <= r[2] < high])
        widths, after = I.followed_widths(part, carried, piece_rows=16)
        got |= {(r["run_id"], r["seq"]): r["after"] for r in widths.collect()}
        if carried is not None:
            after = after.unionByName(carried.join(after, "run_id", "left_anti"))
        carried = spark.createDataFrame(after.collect(), after.schema)
    for run in ("a", "late", "early"):
        assert {seq: w for (name, seq), w in got.items() if name == run} == by_rule([r for r in rows if r[0] == run])


def test_stream_of_widths_splits_runs_and_resumes(spark, tmp_path, monkeypatch):
    """One run that never reports over several micro-batches; the batch that fails half way is run again."""
    from granary.streaming import telemetry as ST

    monkeypatch.setattr(I, "PIECE_ROWS", 16)
    rows = odd_log("never", 130) + [sample("b", i, i, rows=7, tp=float(i % 9)) for i in range(60)]
    real, seen = ST.followed_widths, []

    def lost(slim, carried):
        seen.append(slim.count())
        if len(seen) == 2:
            raise RuntimeError("executor lost")
        return real(slim, carried, piece_rows=16)

    monkeypatch.setattr(ST, "followed_widths", lost)
    arrivals, path, states, checkpoint = (str(tmp_path / x) for x in ("in", "out", "states", "checkpoint"))
    for low, high in ((0, 50), (50, 100), (100, 130)):
        frame(spark, [r for r in rows if low <= r[2] < high]).write.mode("append").parquet(arrivals)
        start = lambda: ST.stream_adaptive_window(spark.readStream.schema(SCHEMA).parquet(arrivals), path, states, checkpoint)
        if len(seen) == 1:
            with pytest.raises(Exception, match="executor lost"):
                start()
        start()
    got = {(r["run_id"], r["seq"]): r["window_seconds"] for r in spark.read.parquet(path).collect()}
    assert len(got) == len(rows)
    for run in ("a", "b"):
        assert {seq: w for (name, seq), w in got.items() if name == run} == by_rule([r for r in rows if r[0] == run])


def test_end_of_stream_closes_all_windows(spark, tmp_path):
    from granary.streaming import telemetry as ST

    samples = frame(spark, [sample("a", i * 3, i, rows=i) for i in range(20)])
    arrivals, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for piece in (samples, ST.end_of_stream(samples), ST.end_of_stream(samples)):
        piece.write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(SCHEMA).parquet(arrivals)
        ST.run_to_table(ST.stream_throughput(stream), out, state)
    columns = ["run_id", "window_start", "rows"]
    want = ST.stream_throughput(samples).select(*columns).collect()
    assert sorted(spark.read.parquet(out).select(*columns).collect()) == sorted(want) and len(want) > 60
    assert ST.end_of_stream(samples.where("seq < 0")).count() == 0


def test_adaptive_window_jobs_do_not_grow_with_slices(spark):
    def jobs(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        group = f"widths-{partitions}"
        spark.sparkContext.setJobGroup(group, group)
        rows = [sample("a", i, i, rows=5, tp=1000.0 * (1 + (i % 2) * 0.6)) for i in range(300)]
        I.adaptive_window(frame(spark, rows)).collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    try:
        assert abs(jobs(8) - jobs(24)) <= 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_variation(spark):
    rng = random.Random(1)
    rows = [sample("a", i, i, tp=rng.random() * 100 + 1) for i in range(100)]
    got = ordered(I.throughput_cv(frame(spark, rows)), "cv")
    expected = [cv for *_x, cv in controller(rows)]
    assert got[:3] == [None] * 3
    assert got[3:] == pytest.approx(expected[3:])


def test_running_numbers_across_slices(spark):
    rng = random.Random(2)
    rows = [sample("a", i * 2, i, rows=rng.randrange(9), ram=rng.random() * 100, cpu=rng.random() * 100) for i in range(200)]
    df = frame(spark, rows)
    assert ordered(I.running_totals(df), "rows_seen") == list(np.cumsum([r[5] for r in rows]))
    assert ordered(I.running_peaks(df), "ram_peak") == list(np.maximum.accumulate([r[6] for r in rows]))
    rates = ordered(I.tick_throughput(df), "rows_per_second")
    assert rates[0] is None and rates[1:] == [r[5] / 2 for r in rows[1:]]


def test_last_active_action_skips_guard_steps(spark):
    df = frame(spark, [sample("a", i, i) for i in range(60)]).withColumn(
        "action", F.when(F.col("seq") % 20 == 0, F.col("seq"))
    )
    got = ordered(I.last_active_action(df), "rewarded_action")
    assert got == [None] + [(i - 1) // 20 * 20 for i in range(1, 60)]


def test_bandit_against_numpy(spark):
    rng = np.random.default_rng(5)
    xs = rng.random((50, 5))
    actions, rewards = rng.integers(0, 6, 50), rng.normal(size=50)
    names = [f"x{i}" for i in range(5)]
    rows = [(int(a), float(r), *map(float, x)) for a, r, x in zip(actions, rewards, xs)]
    df = spark.createDataFrame(rows, ["action", "reward", *names])
    stats = B.linucb_statistics(df, "action", names, "reward")
    got = B.linucb_scores(df, stats, names).collect()
    a = [np.eye(5) for _ in range(7)]
    b = [np.zeros(5) for _ in range(7)]
    for act, r, x in zip(actions, rewards, xs):
        a[act] += np.outer(x, x)
        b[act] += r * x
    for row in got:
        x = np.array([row[n] for n in names])
        scores = [np.linalg.solve(a[i], b[i]) @ x + 1.1 * np.sqrt(x @ np.linalg.solve(a[i], x)) for i in range(7)]
        assert row["best_action"] == int(np.argmax(scores))
        assert row["best_score"] == pytest.approx(max(scores))


def test_eta(spark):
    df = spark.createDataFrame([(10.0, 0, 4), (10.0, 2, 4), (10.0, 5, 4)], "e double, d int, t int")
    assert [r["remaining_seconds"] for r in I.eta(df, "e", "d", "t").collect()] == [40.0, 10.0, 0.0]


def test_known_steps_are_followed_at_once():
    """Widths behind many known steps, from every start, against one step after the other."""
    rng = random.Random(4)
    for n in (1, 2, 9, 300):
        steps = [rng.choice([-0.5, 0.0, 0.5, 0.5]) for _ in range(n)]
        own, ends = I._clamped(np.array(steps), np.array(I.GRID))
        for k, width in enumerate(I.GRID):
            out = []
            for step in steps:
                width = I.moved(width, step)
                out.append(width)
            assert ends[k] == out[-1] and (k or own.tolist() == out)
