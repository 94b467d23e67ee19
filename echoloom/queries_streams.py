"""The registered queries of streams over several micro-batches, and the same results as DuckDB SQL.

Tables arrive in parts, one after the other: rows by their time, and some of them one to three parts late.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from .operators import metrics
from .operators.repetition import with_repetition
from .queries import _docs, _events, _EVENTS, _FIRST, read
from .shared import drop_path, new_path, stored
from .streaming import late, stops

PARTS = 5
EVENT_DELAY, DOC_DELAY = timedelta(days=1), timedelta(minutes=30)


def _arrive(rows, out, time_col, delay, then=None):
    """Lets the parts of (columns, part) arrive in their order: each is written, by as many tasks as read it, then split
    in late rows and others as a batch of its own, and ``then`` goes on with the stream of the others."""
    spark, schema = rows.sparkSession, rows.drop("part").schema
    for k in range(PARTS):
        rows.filter(F.col("part") == k).drop("part").write.parquet(f"{out}/in/part={k}")
        _finished(spark, late.split_late(spark.readStream.schema(schema).parquet(f"{out}/in/part=*"), time_col, delay, f"{out}/split", f"{out}/c1"))
        if then:
            _finished(spark, then(late.rows_in_time(spark, f"{out}/split", schema)))


def _part(place, key):
    """The part with which a row comes: that of its time, or later ones for some keys."""
    delayed = F.when(key % 37 == 0, 2).otherwise(0) + F.when(key % 11 == 0, 1).otherwise(0)
    return F.least(F.lit(PARTS - 1), place + delayed).cast("int")


def _event_rows(spark, d):
    rows = read(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    return rows.withColumn("part", _part(F.floor((F.dayofmonth("ts") - 1) / 6), F.col("event_id")))


def _finished(spark, query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def _kept(frame, out):
    """The result in a table of its own, without the folders of the stream."""
    result, _ = stored(frame)
    drop_path(frame.sparkSession, out)
    return result


_MINUTE = "yyyy-MM-dd HH:mm"


def stream_sessions(spark, d):
    """Sessions of each user's events with six hours between them, of the rows in time, as they were closed."""
    out = new_path(spark)
    rows = _event_rows(spark, d)
    counts = lambda kept: late.session_counts(kept, "ts", EVENT_DELAY, F.col("event_type") == "error", "6 hours", ("user_id",))
    _arrive(rows, out, "ts", EVENT_DELAY, lambda kept: late.append_closed(counts(kept), f"{out}/closed", f"{out}/c2"))
    closed = spark.read.schema(counts(rows).schema).parquet(f"{out}/closed")
    return _kept(closed.select("user_id", F.date_format("start", _MINUTE).alias("start"), F.date_format("end", _MINUTE).alias("end"), "n_texts", "n_loops"), out)


def stream_late(spark, d):
    """The events that came after the watermark had passed them."""
    out = new_path(spark)
    rows = _event_rows(spark, d)
    _arrive(rows, out, "ts", EVENT_DELAY)
    return _kept(late.late_rows(spark, f"{out}/split", rows.drop("part").schema).select("event_id", "batch"), out)


def stream_loop_windows(spark, d):
    """Loop rates of documents in sliding windows, with the detector on the stream, of the rows in time."""
    out = new_path(spark)
    minute = F.col("doc_id") % 400
    rows = _docs(spark, d).select("doc_id", "text", (F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(mins=minute.cast("int"))).alias("ts"), _part(F.floor(minute / 100), F.col("doc_id")).alias("part"))
    counts = lambda kept: late.window_counts(with_repetition(kept), "ts", DOC_DELAY, F.col("hit").isNotNull(), "60 minutes", "20 minutes")
    _arrive(rows, out, "ts", DOC_DELAY, lambda kept: late.append_closed(counts(kept), f"{out}/closed", f"{out}/c2"))
    closed = spark.read.schema(counts(rows).schema).parquet(f"{out}/closed")
    return _kept(closed.select(F.date_format("start", _MINUTE).alias("start"), "n_texts", "n_loops", F.round("loop_rate", 6).alias("loop_rate")), out)


def stream_stops(spark, d):
    """The first plateau of each kind of event's values, by state with a timer, of the events in time."""
    out = new_path(spark)
    rows = _event_rows(spark, d)
    found = lambda kept: stops.stops(kept, "event_type", "event_id", "value", patience=10, min_delta=5.0, time_col="ts", delay=EVENT_DELAY)
    _arrive(rows, out, "ts", EVENT_DELAY, lambda kept: stops.append_stops(found(kept), f"{out}/stops", f"{out}/c2"))
    return _kept(spark.read.schema(stops.STOPS).parquet(f"{out}/stops").select(F.col("key").alias("event_type"), F.col("plateau_step").alias("event_id")), out)


def plateau_stop_delta(spark, d):
    """Plateaus where only a rise by more than 5 counts."""
    return metrics.plateau_stop(_events(spark, d), "event_type", "step", "value", patience=10, min_delta=5.0)


def queries():
    every = (stream_sessions, stream_late, stream_loop_windows, stream_stops, plateau_stop_delta)
    return {f.__name__: f for f in every}


_LATE_EVENTS = """a AS (SELECT *, CAST(least(4, (day(ts) - 1) // 6 + CASE WHEN event_id % 37 = 0 THEN 2 ELSE 0 END + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS batch FROM events),
top AS (SELECT batch, max(ts) AS top FROM a GROUP BY batch),
marks AS (SELECT b.batch, (SELECT max(top) FROM top t WHERE t.batch < b.batch) - INTERVAL 1 DAY AS mark FROM top b),
rows AS (SELECT a.*, coalesce(ts <= mark, false) AS late FROM a JOIN marks USING (batch))"""
#: The rule itself, a step a log: best value, the log since which it holds, and the first stop.
_PLATEAU = """fold AS (
  SELECT k, 1 AS n, value AS best, 1 AS since, CAST(NULL AS BIGINT) AS stop FROM log WHERE n = 1
  UNION ALL
  SELECT f.k, l.n, CASE WHEN l.value - f.best > 5.0 THEN l.value ELSE f.best END, CASE WHEN l.value - f.best > 5.0 THEN l.n ELSE f.since END,
    CASE WHEN l.value - f.best <= 5.0 AND l.n - f.since >= 10 THEN l.step END
  FROM fold f JOIN log l ON l.k = f.k AND l.n = f.n + 1 WHERE f.stop IS NULL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "stream_sessions": f"""WITH {_LATE_EVENTS},
s AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM rows WHERE NOT late),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number FROM s),
c AS (SELECT user_id, min(ts) AS first, max(ts) + INTERVAL 6 HOUR AS last, count(*) AS n_texts, count(*) FILTER (event_type = 'error') AS n_loops FROM g GROUP BY user_id, number)
SELECT user_id, strftime(first, '%Y-%m-%d %H:%M') AS start, strftime(last, '%Y-%m-%d %H:%M') AS "end", n_texts, n_loops FROM c WHERE last <= (SELECT max(ts) FROM rows WHERE NOT late) - INTERVAL 1 DAY""",
        "stream_late": f"WITH {_LATE_EVENTS} SELECT event_id, batch FROM rows WHERE late",
        "stream_loop_windows": f"""{_FIRST},
a AS (SELECT d.doc_id, h.doc_id IS NOT NULL AS found, d.doc_id % 400 AS minute, CAST(least(4, (d.doc_id % 400) // 100 + CASE WHEN d.doc_id % 37 = 0 THEN 2 ELSE 0 END + CASE WHEN d.doc_id % 11 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS batch FROM documents d LEFT JOIN looped h USING (doc_id)),
top AS (SELECT batch, max(minute) AS top FROM a GROUP BY batch),
marks AS (SELECT b.batch, (SELECT max(top) FROM top t WHERE t.batch < b.batch) - 30 AS mark FROM top b),
rows AS (SELECT a.* FROM a JOIN marks USING (batch) WHERE coalesce(minute > mark, true)),
w AS (SELECT *, (minute // 20) * 20 - 20 * k.k AS first FROM rows, (SELECT unnest(range(3)) AS k) k)
SELECT strftime(TIMESTAMP '2024-01-01' + to_minutes(first), '%Y-%m-%d %H:%M') AS start, count(*) AS n_texts, count(*) FILTER (found) AS n_loops, round(100.0::DOUBLE * count(*) FILTER (found) / count(*), 6) AS loop_rate
FROM w WHERE first + 60 <= (SELECT max(minute) FROM rows) - 30 GROUP BY first""",
        "stream_stops": f"""WITH RECURSIVE {_LATE_EVENTS},
log AS (SELECT event_type AS k, event_id AS step, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM rows WHERE NOT late AND ts <= (SELECT max(ts) FROM rows) - INTERVAL 1 DAY),
{_PLATEAU} SELECT k AS event_type, stop AS event_id FROM fold WHERE stop IS NOT NULL""",
        "plateau_stop_delta": f"""WITH RECURSIVE {_EVENTS.removeprefix("WITH ")}, log AS (SELECT event_type AS k, step, value, step AS n FROM ev),
{_PLATEAU} SELECT k AS event_type, max(stop) AS stop_step FROM fold GROUP BY k""",
    }
