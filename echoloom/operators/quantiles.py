"""Exact quantiles of groups of any size by refining counted cells.

Equal values are counted first, which map-side partial sums make cheap where values repeat. The counted values fall in
cells that ascend with the value, by the logarithm of its size; counts of cells tell the cell in which a quantile
lies, and its values are cut in ``_WAYS`` equal parts, again and again, until it holds at most ``cell_rows`` different
ones. Only those are put in order. So no task gets a group's values, and only cells' counts are summed in order.

Values are taken as doubles. Nulls are left out; a group without values has null quantiles. NaN is above all numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import drop_path, stored

_WAYS = 256
#: Cells for each doubling of a value's size.
_PER_DOUBLING = 64


def _cell(v: Column) -> Column:
    """A number that doesn't fall where the value rises: half doubles span less than 2,200 doublings."""
    size = F.floor((F.log2(F.abs(v)) + 1100) * _PER_DOUBLING).cast("bigint") + 1
    top = F.lit(4096 * _PER_DOUBLING).cast("bigint")
    return F.when(F.isnan(v), top + 1).when(F.abs(v) == float("inf"), F.signum(v).cast("bigint") * top).when(v == 0, F.lit(0).cast("bigint")).otherwise(F.signum(v).cast("bigint") * size)


def exact_quantiles(rows: DataFrame, by: list[str], value: str, quantiles: dict[str, float], form: str = "interpolated", cell_rows: int = 4096) -> DataFrame:
    """Per group a column for each named quantile: ``interpolated`` between its two neighbours, or ``lower``, the
    smallest value with at least that share of the rows at or below it."""
    if form not in ("interpolated", "lower"):
        raise ValueError(f"form must be interpolated or lower, not {form!r}")
    spark = rows.sparkSession
    own = [f"__by_{k}" for k in range(len(by))]
    given = rows.select(*(F.col(c).alias(o) for c, o in zip(by, own, strict=True)), F.col(value).cast("double").alias("v"))
    counted = given.filter(F.col("v").isNotNull()).groupBy(*own, "v").agg(F.count("*").alias("n"))
    counted, path = stored(counted.withColumn("cell", _cell(F.col("v"))))
    group = F.struct(F.lit(0), *own)  # also where there is one group
    cells = counted.groupBy(group.alias("g"), "cell").agg(F.sum("n").alias("n"), F.count("*").alias("values"), F.min("v").alias("low"), F.max("v").alias("high"))
    totals = cells.groupBy("g").agg(F.sum("n").alias("total"))
    # the places, from 0, of the values that each quantile needs
    asked = []
    for k, q in enumerate(quantiles.values()):
        if form == "lower":
            asked.append(F.struct(F.lit(k).alias("k"), (F.greatest(F.ceil(F.lit(float(q)) * F.col("total")), F.lit(1)) - 1).cast("bigint").alias("place"), F.lit(1.0).alias("share")))
        else:
            at = (F.col("total") - 1) * F.lit(float(q))
            part = at - F.floor(at)
            asked += [F.struct(F.lit(k).alias("k"), F.floor(at).cast("bigint").alias("place"), (1 - part).alias("share")), F.struct(F.lit(k).alias("k"), F.ceil(at).cast("bigint").alias("place"), part.alias("share"))]
    wanted = totals.select("g", F.explode(F.array(*asked)).alias("x")).select("g", "x.place").distinct()

    def found(cells: DataFrame, left: list[str], order: str) -> DataFrame:
        """Of counted cells the one that holds the place, with the place in it."""
        upto = F.sum("n").over(Window.partitionBy("g", *left).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return cells.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n")).filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("upto")))

    state = found(cells.join(wanted.withColumn("rest", F.col("place")), "g"), ["place"], "cell")
    state = state.select("g", "place", "cell", (F.col("rest") - F.col("before")).alias("rest"), "values", "low", "high")
    state, at = stored(state)
    paths = [path, at]
    keyed = counted.select(group.alias("g"), "cell", "v", "n")
    inside = lambda: keyed.join(state.select("g", "cell", "place", "rest", "low", "high"), ["g", "cell"]).filter((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
    while (state.agg(F.max("values")).first()[0] or 0) > cell_rows:
        half = (F.col("high") / 2 - F.col("low") / 2) / (_WAYS / 2)  # a part's width, also where high - low overflows
        part = F.least(F.floor((F.col("v") - F.col("low")) / half), F.lit(_WAYS - 1))
        parts = inside().withColumn("part", F.when(F.col("low") == F.col("high"), 0).otherwise(part))
        counts = parts.groupBy("g", "cell", "place", "rest", "part").agg(F.sum("n").alias("n"), F.count("*").alias("values"), F.min("v").alias("low"), F.max("v").alias("high"))
        state = found(counts, ["place"], "part").select("g", "place", "cell", (F.col("rest") - F.col("before")).alias("rest"), "values", "low", "high")
        state, at = stored(state)
        paths.append(at)
    values = found(inside(), ["place"], "v").select("g", "place", "v")
    each = totals.select("g", F.explode(F.array(*asked)).alias("x")).select("g", "x.*").join(values, ["g", "place"])
    # a neighbour with no share doesn't count, be it infinite
    sums = each.groupBy("g").agg(*(F.sum(F.when((F.col("k") == k) & (F.col("share") > 0), F.col("share") * F.col("v"))).alias(f"q{k}") for k in range(len(quantiles))))
    held = sums.select(*(F.col("g")[o].alias(c) for o, c in zip(own, by, strict=True)), *(F.col(f"q{k}").alias(c) for k, c in enumerate(quantiles)))
    if not by:
        out, at = stored(spark.range(1).join(held, how="left").select(*quantiles))  # one row
    else:
        groups = rows.select(*(F.col(c) for c in by)).distinct()
        same = [groups[c].eqNullSafe(held[c]) for c in by]
        out, at = stored(groups.join(held, same, "left").select(*(groups[c] for c in by), *quantiles))
    for p in paths:
        drop_path(spark, p)
    return out
