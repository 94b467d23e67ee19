"""Stops of metric logs on a stream: a series' best value and patience are kept as state, one state a key.

A series is a key's logs in the order of their steps. With a delay, logs may come out of order: they wait in state until
the watermark has passed their time, told by one timer a key at the earliest of them, and are then taken in order; they
wait packed, thousands an entry of the state, and come and go as arrays. So
the stops are those of the whole log, however it is cut into micro-batches, and after a restart from the checkpoint as
well. A stopped series drops what waits, and its further logs. Logs older than the watermark are dropped by the engine;
``late.split_late`` before it keeps them aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_LOG, _TOGETHER = np.dtype([("step", np.int64), ("at", np.int64), ("value", np.float64)]), 1 << 15
STOPS = "key string, threshold_step long, plateau_step long"


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that state with timers needs, for queries started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class _Series(StatefulProcessor):
    """The state of a key; rows out are stops as they happen."""

    def __init__(self, threshold: float | None, patience: int, min_delta: float, higher: bool, waits: bool) -> None:
        self.threshold, self.patience, self.min_delta, self.sign, self.waits = threshold, patience, min_delta, 1 if higher else -1, waits

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "best double, since long, n long, reached boolean, stopped boolean")
        self.waiting = handle.getMapState("waiting", "number long", "logs binary")  # packed, ``_TOGETHER`` logs an entry

    def _held(self) -> tuple:
        held = self.state.get() if self.state.exists() else None
        return held if held is not None else (None, 0, 0, self.threshold is None, False)

    def _take(self, key: str, logs: np.ndarray) -> Iterator[pd.DataFrame]:
        """Takes logs in the order of their steps."""
        best, since, n, reached, stopped = self._held()
        out, logs = [], logs[np.lexsort((logs["value"], logs["step"]))]
        for step, value in zip(logs["step"].tolist(), logs["value"].tolist(), strict=True):
            if stopped and reached:
                break
            v = self.sign * value
            n += 1
            if not reached and v >= self.sign * self.threshold:
                reached = True
                out.append((key, step, None))
            if stopped:
                continue
            if best is None or v - best > self.min_delta:
                best, since = v, n
            elif n - since >= self.patience:
                stopped = True
                out.append((key, None, step))
        self.state.update((best, since, n, reached, stopped))
        if out:
            yield pd.DataFrame({"key": [k for k, _, _ in out], "threshold_step": pd.array([t for _, t, _ in out], "Int64"), "plateau_step": pd.array([p for _, _, p in out], "Int64")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        *_, reached, stopped = self._held()
        if reached and stopped:
            return  # further logs of a stopped series
        logs = [np.fromiter(zip(x["step"], x["at"], x["value"], strict=True), _LOG, len(x)) for x in rows]
        logs = np.concatenate(logs) if logs else np.empty(0, _LOG)
        if not self.waits:
            yield from self._take(key[0], logs)
        elif len(logs):
            self._wait(logs, 1 + max((k[0] for k in self.waiting.keys()), default=-1))

    def _wait(self, logs: np.ndarray, number: int) -> None:
        """Lets logs wait, and sets the timer to the earliest."""
        for k, at in enumerate(range(0, len(logs), _TOGETHER)):
            self.waiting.updateValue((number + k,), (logs[at : at + _TOGETHER].tobytes(),))
        told = list(self.handle.listTimers())
        first = min([int(logs["at"].min()), *told])
        if first not in told:
            for at in told:
                self.handle.deleteTimer(at)
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        parts = sorted((k[0], bytes(v[0])) for k, v in self.waiting.iterator())
        for number, _ in parts:
            self.waiting.removeKey((number,))
        logs = np.frombuffer(b"".join(x for _, x in parts), _LOG)[::-1]
        logs = logs[np.unique(logs["step"], return_index=True)[1]]  # of several logs of a step the last one that came
        due = logs["at"] <= now
        yield from self._take(key[0], logs[due])
        *_, reached, stopped = self._held()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if not (reached and stopped) and not due.all():
            self._wait(logs[~due], 0)

    def close(self) -> None:
        pass


def stops(log: DataFrame, key: str, step: str, value: str, *, threshold: float | None = None, patience: int = 10, min_delta: float = 0.0, higher: bool = True, time_col: str | None = None, delay: timedelta | None = None) -> DataFrame:
    """A stream of stops: key, threshold_step or plateau_step, a row each.

    Without ``time_col`` each micro-batch's logs are taken in the order of their steps, and batches in turn; with it logs
    wait for the watermark, ``delay`` behind the newest time.
    """
    waits = time_col is not None
    rows = log.withWatermark(time_col, f"{delay // timedelta(microseconds=1)} microseconds") if waits else log
    at = F.unix_millis(F.col(time_col).cast("timestamp")) if waits else F.lit(0).cast("long")
    columns = [F.col(key).cast("string").alias("key"), F.col(step).cast("long").alias("step"), at.alias("at"), F.col(value).cast("double").alias("value")]
    rows = rows.select(*columns, *([F.col(time_col)] if waits else [])).filter(F.col("value").isNotNull())
    processor = _Series(threshold, patience, min_delta, higher, waits)
    return rows.groupBy("key").transformWithStateInPandas(processor, STOPS, "append", "eventTime" if waits else "none")


def append_stops(result: DataFrame, out: str, checkpoint: str):
    """Appends stops to the table <out>; returns the query."""
    with keyed_state(result.sparkSession):
        return result.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
