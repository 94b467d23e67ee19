"""All maximal repetitions of a text, as a table function.

A run is a part of a text that repeats with a period, as often as asked, and can't be made longer on either side; its
period is the smallest that it has. The detector gives the first loop that a probe meets; this gives every one, with
periods shorter than a probe too. For each period the places that equal the one a period later are compared as a whole
vector, and stretches of them are runs, so the work is the length of a text times the longest period.

Null and short texts have no runs. Runs of one text come by start, then period; they may overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "start int, end int, period int, repeats int, unit string"


def all_runs(text: str | None, min_repeats: int = 4, min_total: int = 60, max_period: int = 1024) -> list[tuple[int, int, int, int, str]]:
    """start, end, period, whole repeats and unit (100 characters of it) of each maximal run."""
    if not text or min_repeats < 2:
        return []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, out = len(codes), []
    for period in range(1, min(max_period, n // min_repeats) + 1):
        least = max(min_repeats * period, min_total) - period  # places that equal the one a period later
        same = np.flatnonzero(np.diff(np.concatenate([[0], (codes[:-period] == codes[period:]).view(np.int8), [0]])))
        for start, stop in same.reshape(-1, 2)[same[1::2] - same[::2] >= least].tolist():
            end = stop + period
            if not any(period % d == 0 and np.array_equal(codes[start : end - d], codes[start + d : end]) for d in range(1, period // 2 + 1)):
                out.append((start, end, period, (end - start) // period, text[start : start + min(period, 100)]))
    return sorted(out)


def runs_function(max_period: int = 1024):
    """The table function: runs of (text, min_repeats, min_total)."""

    @F.udtf(returnType=RUN)
    class Runs:
        def eval(self, text: str, min_repeats: int, min_total: int) -> Iterator[tuple]:
            yield from all_runs(text, min_repeats, min_total, max_period)

    return Runs


def register_runs(spark: SparkSession, name: str = "all_runs", max_period: int = 1024) -> None:
    """Makes the function known to SQL: SELECT ... FROM texts, LATERAL all_runs(text, 4, 60)."""
    spark.udtf.register(name, runs_function(max_period))


def with_runs(df: DataFrame, text: str, min_repeats: int = 4, min_total: int = 60, max_period: int = 1024) -> DataFrame:
    """A row for each run of each text, beside its columns; texts without runs have none."""
    register_runs(df.sparkSession, "__all_runs", max_period)
    return df.sparkSession.sql(f"SELECT * FROM {{rows}}, LATERAL __all_runs(`{text}`, {min_repeats}, {min_total})", rows=df)
