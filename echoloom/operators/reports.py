"""Counts and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def loop_rate(rows: DataFrame, found: Column, *by: str) -> DataFrame:
    """n_texts, n_loops and loop_rate (percent of texts, 0 without texts) in total or by columns."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n_texts"), F.count_if(found).alias("n_loops"))
    return out.withColumn("loop_rate", F.lit(100.0) * F.col("n_loops") / F.greatest("n_texts", F.lit(1)))


def rate_change(rates: DataFrame, round_col: str = "round") -> DataFrame:
    """Loop rates of rounds of training with the change from the round before."""
    return rates.withColumn("change", F.col("loop_rate") - F.lag("loop_rate").over(Window.orderBy(round_col)))


def shares(rows: DataFrame, key: str) -> DataFrame:
    counts = rows.groupBy(key).agg(F.count("*").alias("cnt"))
    total = counts.agg(F.sum("cnt").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select(key, "cnt", (F.col("cnt") / F.col("total")).alias("share"))


def top_counts(rows: DataFrame, key: str, limit: int = 8) -> DataFrame:
    """The most frequent values, equal counts in the order of the values."""
    return rows.groupBy(key).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), key).limit(limit)


def top_of_each(rows: DataFrame, columns: list[str], limit: int = 8) -> DataFrame:
    """The most frequent values of each column (name, value, cnt), by grouping sets in one pass."""
    kinds = rows.select(*(F.col(c).cast("string").alias(c) for c in columns))
    counts = kinds.groupingSets([[F.col(c)] for c in columns], *columns).agg(F.grouping_id().alias("__id"), F.count("*").alias("cnt"))
    # the bit of a column that is summed over is 1; the first column's is the highest
    alone = {c: (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - k)) for k, c in enumerate(columns)}
    name = F.create_map(*[F.lit(x) for c, n in alone.items() for x in (n, c)])[F.col("__id").cast("int")]
    value = F.coalesce(*(F.when(F.col("__id") == n, F.col(c)) for c, n in alone.items()))
    listed = counts.select(name.alias("name"), value.alias("value"), "cnt")
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("cnt"), "value"))
    return listed.withColumn("__rank", rank).filter(F.col("__rank") <= limit).drop("__rank")
