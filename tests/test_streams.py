"""Stateful streams over several micro-batches, with rows out of order and restarts, against the whole table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from echoloom.operators import metrics
from echoloom.streaming import late, stops

T0 = dt.datetime(2024, 1, 1)


def series(seed, keys="abc", n=120):
    rng = random.Random(seed)
    out = []
    for k in keys:
        v = 0.0
        for step in range(n):
            v += rng.choice((0.4, 0.1, -0.2, -0.3))
            out.append((k, step, round(v, 2), T0 + dt.timedelta(minutes=step)))
    return out


SCHEMA = "key string, step long, value double, ts timestamp"


def batch_stops(spark, rows, **options):
    log = spark.createDataFrame(rows, SCHEMA)
    plateau = {r["key"]: r["stop_step"] for r in metrics.plateau_stop(log, "key", "step", "value", **options).collect()}
    return {k: v for k, v in plateau.items() if v is not None}


def arrive(spark, rows, path, number):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/in/batch={number}")


def run_stops(spark, path, **options):
    log = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/batch=*")
    query = stops.append_stops(stops.stops(log, "key", "step", "value", **options), f"{path}/out", f"{path}/state")
    assert query.awaitTermination(240)


@pytest.mark.parametrize("cuts", [[30, 31, 200], [300]])
def test_stops_of_any_cut_and_after_restarts(spark, tmp_path, cuts):
    """The log comes in order, cut at any places, with the query started anew for each part."""
    rows = sorted(series(1), key=lambda r: (r[1], r[0]))
    options = dict(patience=7, min_delta=0.3)
    low = 0
    for number, high in enumerate([*cuts, len(rows)]):
        arrive(spark, rows[low:high], tmp_path, number)
        run_stops(spark, tmp_path, threshold=1.5, **options)
        low = high
    got = spark.read.schema(stops.STOPS).parquet(f"{tmp_path}/out").collect()
    assert {r["key"]: r["plateau_step"] for r in got if r["plateau_step"] is not None} == batch_stops(spark, rows, **options)
    log = spark.createDataFrame(rows, SCHEMA)
    want = {r["key"]: r["stop_step"] for r in metrics.threshold_stop(log, "key", "step", "value", 1.5).collect()}
    reached = [(r["key"], r["threshold_step"]) for r in got if r["threshold_step"] is not None]
    assert dict(reached) == {k: v for k, v in want.items() if v is not None} and len(reached) == len(dict(reached))


def test_stops_of_logs_out_of_order_wait_for_the_watermark(spark, tmp_path):
    """Logs come up to 20 minutes out of order; a restart in between; then later logs push the watermark on."""
    rng = random.Random(7)
    rows = series(5)
    mixed = sorted(rows, key=lambda r: r[3] + dt.timedelta(minutes=rng.uniform(0, 20)))
    options = dict(patience=6, higher=False)
    push = [("z", 0, 0.0, T0 + dt.timedelta(days=2))]
    for number, part in enumerate((mixed[:110], mixed[110:240], mixed[240:], push)):
        arrive(spark, part, tmp_path, number)
        run_stops(spark, tmp_path, time_col="ts", delay=dt.timedelta(minutes=25), **options)
    got = {r["key"]: r["plateau_step"] for r in spark.read.schema(stops.STOPS).parquet(f"{tmp_path}/out").collect()}
    assert got == batch_stops(spark, rows, **options) and got


def test_late_rows_and_windows(spark, tmp_path):
    """Five arrivals: what is older than the watermark is kept aside, everything else is in the windows, once."""
    rng = random.Random(3)
    rows = [(k, f"u{rng.randrange(3)}", rng.random() < 0.3, T0 + dt.timedelta(seconds=rng.randrange(0, 6000) + 3000 * (k // 100))) for k in range(500)]
    schema = "id long, user string, found boolean, ts timestamp"
    delay = dt.timedelta(minutes=20)
    newest, want_late, in_time = None, [], []
    for number in range(5):
        part = rows[100 * number : 100 * number + 100]
        spark.createDataFrame(part, schema).coalesce(2).write.parquet(f"{tmp_path}/in/batch={number}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/batch=*")
        assert late.split_late(stream, "ts", delay, f"{tmp_path}/split", f"{tmp_path}/ck").awaitTermination(120)
        old = [r for r in part if newest is not None and r[3] <= newest - delay]
        want_late += [(r[0], number) for r in old]
        fresh = [r for r in part if r not in old]
        in_time += fresh
        newest = max([r[3] for r in fresh] + ([newest] if newest else []))
        kept = late.rows_in_time(spark, f"{tmp_path}/split", spark.createDataFrame([], schema).schema)
        hit = F.col("found")
        for name, frame in (("sliding", late.window_counts(kept, "ts", delay, hit, "30 minutes", "10 minutes")), ("sessions", late.session_counts(kept, "ts", delay, hit, "3 minutes", ("user",)))):
            assert late.append_closed(frame, f"{tmp_path}/{name}", f"{tmp_path}/{name}-ck").awaitTermination(120)
    got = late.late_rows(spark, f"{tmp_path}/split", spark.createDataFrame([], schema).schema)
    assert sorted((r["id"], r["batch"]) for r in got.collect()) == sorted(want_late) and want_late
    closed = newest - delay
    sliding = {}
    for _, _, found, ts in in_time:
        first = T0 + dt.timedelta(minutes=((ts - T0) // dt.timedelta(minutes=10)) * 10)
        for k in range(3):
            start = first - dt.timedelta(minutes=10 * k)
            n = sliding.setdefault(start, [0, 0])
            n[0] += 1
            n[1] += found
    want = {s: tuple(n) for s, n in sliding.items() if s + dt.timedelta(minutes=30) <= closed}
    out = spark.read.parquet(f"{tmp_path}/sliding").collect()
    assert {r["start"]: (r["n_texts"], r["n_loops"]) for r in out} == want and len(out) == len(want)
    sessions = []
    for user in ("u0", "u1", "u2"):
        run = []
        for ts, found in sorted((r[3], r[2]) for r in in_time if r[1] == user):
            if run and ts > run[-1][0] + dt.timedelta(minutes=3):
                sessions.append((user, run))
                run = []
            run.append((ts, found))
        sessions.append((user, run))
    want = sorted((u, run[0][0], run[-1][0] + dt.timedelta(minutes=3), len(run), sum(f for _, f in run)) for u, run in sessions if run[-1][0] + dt.timedelta(minutes=3) <= closed)
    out = spark.read.parquet(f"{tmp_path}/sessions").collect()
    assert sorted((r["user"], r["start"], r["end"], r["n_texts"], r["n_loops"]) for r in out) == want


def test_rows_without_a_time_are_late_and_an_empty_stream_gives_nothing(spark, tmp_path):
    schema = "id long, ts timestamp"
    spark.createDataFrame([(1, None), (2, T0)], schema).write.parquet(f"{tmp_path}/in/batch=0")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in/batch=1")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/batch=*")
    assert late.split_late(stream, "ts", dt.timedelta(0), f"{tmp_path}/split", f"{tmp_path}/ck").awaitTermination(60)
    assert [r["id"] for r in late.late_rows(spark, f"{tmp_path}/split", stream.schema).collect()] == [1]


def test_parts_are_written_by_many_tasks_and_taken_whole(spark, tmp_path):
    """One task wrote a whole part; and a part of many files may not be taken in pieces, whose watermark passes the rest."""
    from echoloom import queries_streams

    rows = spark.range(3000).repartition(3).select("id", (F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(mins=F.floor(F.col("id") / 3).cast("int"))).alias("ts"), F.floor(F.col("id") / 600).cast("int").alias("part"))
    seen, delay = [], dt.timedelta(minutes=30)
    queries_streams._arrive(rows, str(tmp_path), "ts", delay, lambda kept: seen.append(kept) or late.append_closed(late.window_counts(kept, "ts", delay, F.lit(True), "20 minutes"), f"{tmp_path}/closed", f"{tmp_path}/c2"))
    assert len(seen) == 5 and len(list((tmp_path / "in" / "part=0").glob("part-*.parquet"))) == 3
    assert late.late_rows(spark, f"{tmp_path}/split", spark.range(1).schema).count() == 0
    closed = spark.read.parquet(f"{tmp_path}/closed").collect()
    assert len(closed) == 48 and {r["n_texts"] for r in closed} == {60}


def test_logs_wait_packed(spark, tmp_path, monkeypatch):
    """Each waiting log was an entry of the state, written and read one by one."""
    monkeypatch.setattr(stops, "_TOGETHER", 7)
    entries = []

    class Store:
        def __init__(self, *_):
            self.x = {}

        exists, get, update = (lambda s: "v" in s.x), (lambda s: s.x["v"]), (lambda s, v: s.x.__setitem__("v", v))
        keys, iterator, removeKey = (lambda s: iter(list(s.x))), (lambda s: iter(list(s.x.items()))), (lambda s, k: s.x.pop(k))

        def updateValue(self, k, v):
            self.x[k] = v
            entries.append(k)

    class Handle:
        timers: set = set()
        getValueState = getMapState = Store
        listTimers, registerTimer, deleteTimer = (lambda s: iter(list(s.timers))), (lambda s, t: s.timers.add(t)), (lambda s, t: s.timers.discard(t))

    class Now:
        getCurrentWatermarkInMs = lambda s: 25

    import pandas as pd

    p = stops._Series(None, 4, 0.0, True, True)
    p.init(Handle())
    frame = pd.DataFrame({"step": [*range(40, 0, -1), 12], "at": [*range(40, 0, -1), 12], "value": [1.0] * 40 + [9.0]})
    assert list(p.handleInputRows(("k",), iter([frame]), None)) == [] and len(entries) == 6 and Handle.timers == {1}
    got = pd.concat(p.handleExpiredTimer(("k",), Now(), None))
    assert got["plateau_step"].tolist() == [5] and not p.waiting.x and not Handle.timers
    assert list(p.handleInputRows(("k",), iter([frame]), None)) == [] and not p.waiting.x
