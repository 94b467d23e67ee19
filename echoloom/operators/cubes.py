"""Counts by grouping sets with sketches that merge: loop reports of rounds that are added up later.

A cube has a row for each combination of its dimensions, with ``level`` (the grouping id) telling which of them are
summed over. Beside exact counts it holds a HyperLogLog sketch of distinct values (relative deviation
1.04 / sqrt(2 ** log_k), 1.6 % for 12) and an items sketch of the most frequent ones (a count is too low by
at most about 3.5 / size of all items). Cubes of parts of the data merge into the cube of all of it, without
the data: counts add up, sketches unite. Partial aggregates come before the shuffle, so hot combinations are sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cube(rows: DataFrame, dimensions: list[str], counts: dict[str, Column], distinct: str, frequent: str, log_k: int = 12, most_items: int = 1024) -> DataFrame:
    """level, the dimensions, the counts (sums of 0 and 1), ``distinct_sketch`` and ``frequent_sketch``."""
    sums = [F.sum(c.cast("bigint")).alias(name) for name, c in counts.items()]
    sketches = [F.hll_sketch_agg(distinct, F.lit(log_k)).alias("distinct_sketch"), F.expr(f"approx_top_k_accumulate(`{frequent}`, {most_items})").alias("frequent_sketch")]
    return rows.cube(*dimensions).agg(F.grouping_id().alias("level"), *sums, *sketches).select("level", *dimensions, *counts, "distinct_sketch", "frequent_sketch")


def merge(cubes: DataFrame, dimensions: list[str], counts: list[str], most_items: int = 1024) -> DataFrame:
    """One cube of the rows of several: equal combinations are added up."""
    united = [F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.expr(f"approx_top_k_combine(frequent_sketch, {most_items})").alias("frequent_sketch")]
    return cubes.groupBy("level", *dimensions).agg(*(F.sum(c).alias(c) for c in counts), *united)


def estimates(cubes: DataFrame, k: int = 3) -> DataFrame:
    """The cube with ``n_distinct`` and ``top`` (an array of item and count) in place of its sketches."""
    shown = cubes.withColumn("n_distinct", F.hll_sketch_estimate("distinct_sketch")).withColumn("top", F.expr(f"approx_top_k_estimate(frequent_sketch, {k})"))
    return shown.drop("distinct_sketch", "frequent_sketch")
