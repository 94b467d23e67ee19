"""Metric logs: means between logs, stops at a threshold and on a plateau, schedule arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import drop_path, stored


def window_means(log: DataFrame, key: str, step: str, value: str, every: int = 5) -> DataFrame:
    """Per key and run of ``every`` steps (from 1): the mean."""
    return log.groupBy(key, F.floor((F.col(step) - 1) / every).cast("bigint").alias("window")).agg(F.avg(value).alias("mean_value"), F.count("*").alias("n"))


def named(split: Column, key: Column) -> Column:
    return F.when(split == "eval", F.concat(F.lit("eval_"), key)).otherwise(key)


def threshold_stop(log: DataFrame, key: str, step: str, value: str, threshold: float, higher: bool = True) -> DataFrame:
    """Per key the first step at which the value reaches the threshold, null if none does."""
    reached = F.col(value) >= threshold if higher else F.col(value) <= threshold
    return log.groupBy(key).agg(F.min(F.when(reached, F.col(step))).alias("stop_step"))


def numbered(rows: DataFrame, keys: list[str], cell: Column, order: list[Column | str], name: str) -> DataFrame:
    """Adds the number (from 1) of each row of a group in an order; ``cell`` must not fall in that order.

    Rows are numbered in their cells, and counts of the cells before are added, so a group of any size is spread over
    tasks: one window task holds a group's cells, not its rows.
    """
    held = rows.withColumn("__cell", cell)
    counts = held.groupBy(*keys, "__cell").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__cell", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__cell").orderBy(*order))
    return held.withColumn("__in", inside).join(offsets, [*keys, "__cell"]).withColumn(name, F.col("__before") + F.col("__in")).drop("__cell", "__before", "__in")


def records(log: DataFrame, key: str, place: str, value: str, cell_rows: int = 4096) -> DataFrame:
    """The rows with a higher value than all before them in their series, by places that count from 1.

    Maxima of cells of places are compared first; only cells' rows are put in order.
    """
    cell = F.floor((F.col(place) - 1) / cell_rows)
    tops = log.groupBy(key, cell.alias("__cell")).agg(F.max(value).alias("__top"))
    earlier = Window.partitionBy(key).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select(key, "__cell", F.max("__top").over(earlier).alias("__before"))
    inside = F.max(value).over(Window.partitionBy(key, "__cell").orderBy(place).rowsBetween(Window.unboundedPreceding, -1))
    rows = log.withColumn("__cell", cell).withColumn("__inside", inside).join(before, [key, "__cell"])
    best = F.greatest("__before", "__inside")  # null only where nothing is before
    return rows.filter(best.isNull() | (F.col(value) > best)).drop("__cell", "__inside", "__before")


def plateau_stop(log: DataFrame, key: str, step: str, value: str, higher: bool = True, patience: int = 10, min_delta: float = 0.0, cell_steps: int = 4096) -> DataFrame:
    """Per key the first step with ``patience`` logs since the best value last rose by more than ``min_delta``.

    Only a value above all before it can raise the best, so a series is reduced to its records before it is folded in
    order. ``cell_steps`` steps are numbered in one task.
    """
    v = (F.col(value) if higher else -F.col(value)).cast("double")
    # numbered once, in a table; it is read for the records and for the steps of stops
    rows, path = stored(numbered(log.select(key, F.col(step).alias("__step"), v.alias("__v")), [key], F.floor(F.col("__step") / cell_steps), ["__step"], "__place"))
    rising = records(rows, key, "__place", "__v").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("__place").alias("p"), F.col("__v").alias("v")))).alias("xs"))
    zero = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("stop"))

    def fold(s, x):
        risen = s["best"].isNull() | (x["v"] - s["best"] > min_delta)
        stop = F.coalesce(s["stop"], F.when(risen & (x["p"] - s["at"] > patience), s["at"] + patience))
        return F.struct(F.when(risen, x["v"]).otherwise(s["best"]).alias("best"), F.when(risen, x["p"]).otherwise(s["at"]).alias("at"), stop.alias("stop"))

    ends = rising.select(F.col(key).alias("__key"), F.aggregate("xs", zero, fold, lambda s: F.coalesce(s["stop"], s["at"] + patience)).alias("__stop"))  # a row a key
    there = rows.join(ends, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__place") <= F.col("__stop")), "inner")
    out, _ = stored(there.groupBy(key).agg(F.min(F.when(F.col("__place") == F.col("__stop"), F.col("__step").cast("bigint"))).alias("stop_step")))
    drop_path(log.sparkSession, path)
    return out


def estimated_steps(examples: int | Column, epochs: float, batch: int, accumulation: int) -> int | Column:
    """The optimizer steps of a number of examples, given as a number or as a column."""
    exact = examples * epochs / (batch * accumulation)
    return F.ceil(exact) if isinstance(examples, Column) else math.ceil(exact)


def trained_layers(parameters: DataFrame, name: str, layer: Column, last: int) -> DataFrame:
    """Marks the parameters of the last ``last`` layers."""
    rows = parameters.withColumn("layer", layer)
    top = rows.agg(F.max("layer").alias("top"))  # one row
    return rows.join(F.broadcast(top)).withColumn("trainable", F.coalesce(F.col("layer") > F.col("top") - last, F.lit(False))).drop("top")
