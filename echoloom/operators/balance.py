"""Regularised sampling: flat shares of rejected tokens, fair shares of sources.

Counts go through one stored matrix of (token, source), from which rows are picked one by one in numbers; rows are then
taken in the order of a keyed hash. Where a quota cuts a group, hashed cells of the group are counted, and rows are
numbered in cells, so a group of any size is spread over tasks.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import drop_path, stored

#: The modes of source balance.
MODES = ("off", "sqrt", "equal")


def token_ratios(rows: DataFrame, token: str, strength: float) -> DataFrame:
    """token, cnt, ratio: counts above the median are weighted by (median / count) ** strength, then normalised."""
    return ratios_of(rows.groupBy(token).agg(F.count("*").alias("cnt")), token, strength)


def ratios_of(counts: DataFrame, token: str, strength: float) -> DataFrame:
    """``token_ratios`` of (token, cnt)."""
    middle = counts.agg(F.percentile("cnt", F.lit(0.5)).alias("middle"))  # its buffer has one entry a different count
    flat = F.when((F.col("cnt") <= F.col("middle")) | F.lit(strength <= 0), F.lit(1.0)).otherwise(F.pow(F.col("middle") / F.col("cnt"), F.lit(float(strength))))
    weighted = counts.join(F.broadcast(middle)).withColumn("weighted", flat * F.col("cnt"))  # middle is one row
    total = weighted.agg(F.sum("weighted").alias("total"))
    return weighted.join(F.broadcast(total)).select(token, "cnt", (F.col("weighted") / F.col("total")).alias("ratio"))


def share_picks(token: np.ndarray, source: np.ndarray, n: np.ndarray, ratio: np.ndarray, quota: np.ndarray, share: np.ndarray, target: int) -> np.ndarray:
    """How many rows each cell of (token, source) gives when ``target`` rows are picked one by one.

    Each pick is of the token furthest below its ratio of what is picked so far, up to its quota; of equal tokens and
    of a token's sources, of the one furthest below its share; then of the first cell. When all quotas or rows are
    used up, picks go on without quotas. Cells are in the order of tokens, then sources. A pick is a few vector
    operations over the tokens.
    """
    left, seen, chosen, given = n.copy(), np.zeros(len(ratio), np.int64), np.zeros(len(share), np.int64), np.zeros(len(n), np.int64)
    starts = np.searchsorted(token, np.arange(len(ratio) + 1))
    rows = np.bincount(token, weights=n, minlength=len(ratio)).astype(np.int64)
    capped = True
    for picked in range(min(target, int(n.sum()))):
        closed = (rows <= 0) | (seen >= quota) if capped else rows <= 0
        if capped and closed.all():
            capped, closed = False, rows <= 0
        taken = max(picked, 1)
        gap = np.where(closed, -np.inf, ratio - seen / taken)
        tied = np.flatnonzero(gap == gap.max())
        cells = np.arange(starts[tied[0]], starts[tied[0] + 1]) if len(tied) == 1 else np.concatenate([np.arange(starts[t], starts[t + 1]) for t in tied])
        cells = cells[left[cells] > 0]
        k = cells[np.argmax((share - chosen / taken)[source[cells]])]
        left[k] -= 1
        given[k] += 1
        rows[token[k]] -= 1
        seen[token[k]] += 1
        chosen[source[k]] += 1
    return given


def count_matrix(rows: DataFrame, token: str, source: str) -> tuple[DataFrame, str]:
    """The stored counts (token, source, n), from one pass over the rows, and their path."""
    return stored(rows.groupBy(token, source).agg(F.count("*").alias("n")))


def nested_quotas(matrix: DataFrame, token: str, source: str, target: int, strength: float) -> DataFrame:
    """token, source, n, cnt, ratio, quota (of the token, half to even) and take, of cells that give rows or whose token
    has a quota; the picks of ``share_picks`` from the counts alone, for the target or all rows if they are fewer.

    The driver sees only tokens that can be picked: those with a quota, which are at most 2 * target, and of the others
    those with the largest ratios that the ``need`` picks beyond all quotas can reach: of equal ratios the first
    need + 1 tokens of each source. So its cells are bounded by the target and the number of sources, not by the rows.
    """
    target = min(target, matrix.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    counts = matrix.groupBy(token).agg(F.sum("n").alias("cnt"))
    rated = ratios_of(counts, token, strength).withColumn("ratio", F.round("ratio", 12)).withColumn("quota", F.bround(F.col("ratio") * target, 0).cast("bigint"))
    rated, path = stored(rated)
    need = target - (rated.agg(F.sum(F.least("quota", "cnt"))).first()[0] or 0)
    reach, one = F.col("quota") > 0, F.lit(1).cast("bigint")
    cells = matrix.join(rated.withColumnRenamed(token, "__token"), F.col(token).eqNullSafe(F.col("__token"))).drop("__token")
    held = cells.filter(reach)
    if need > 0:
        # equal counts have equal ratios, so there are fewer ratios than sqrt(2 * rows)
        classes = sorted(((r["ratio"], r["n"]) for r in rated.filter(~reach).groupBy("ratio").agg(F.count("*").alias("n")).collect()), reverse=True)
        lowest, more = None, 0
        for ratio, n in classes:
            lowest, more = ratio, more + n
            if more >= need:
                break
        if lowest is not None:
            rest = cells.filter(~reach & (F.col("ratio") >= lowest))
            first = F.row_number().over(Window.partitionBy("ratio", source).orderBy(token))
            near = rest.withColumn("__first", first).filter(F.col("__first") <= need + 1).select(F.col(token).alias("__token")).distinct()
            held = held.unionByName(rest.join(near, F.col(token).eqNullSafe(F.col("__token")), "left_semi"))
    totals = matrix.groupBy(source).agg(F.sum("n").alias("n")).collect()  # a row a source
    got = held.select(token, source, "n", "cnt", "ratio", "quota").toArrow().to_pylist()
    key = lambda x: (x is not None, x or "")
    got.sort(key=lambda r: (key(r[token]), key(r[source])))
    names = sorted((r[source] for r in totals), key=key)
    place = {x: k for k, x in enumerate(names)}
    every = sum(r["n"] for r in totals)
    share = np.array([n / every for n in (dict((r[source], r["n"]) for r in totals)[x] for x in names)])
    tokens = {t: k for k, t in enumerate(dict.fromkeys(r[token] for r in got))}
    firsts = {r[token]: r for r in reversed(got)}
    ratio, quota = (np.array([firsts[t][c] for t in tokens]) for c in ("ratio", "quota"))
    column = lambda f: np.array([f(r) for r in got], np.int64)
    take = share_picks(column(lambda r: tokens[r[token]]), column(lambda r: place[r[source]]), column(lambda r: r["n"]), ratio, quota, share, target) if got else []
    schema = held.select(token, source, "n", "cnt", "ratio", "quota").withColumn("take", one).schema
    out = matrix.sparkSession.createDataFrame([(r[token], r[source], r["n"], r["cnt"], r["ratio"], r["quota"], int(t)) for r, t in zip(got, take, strict=True)], schema)
    drop_path(matrix.sparkSession, path)
    return out


def take_per_group(rows: DataFrame, keys: list[str], quotas: DataFrame, order: str, cell_rows: int = 4096) -> DataFrame:
    """Of each group the first ``quota`` rows by the hexadecimal hash ``order``; groups without a quota go.

    The first digits make cells, as many as the largest group needs for about ``cell_rows`` rows a cell; ``quotas`` has the
    keys, ``quota`` and, for that, ``n``, the rows of the group. Cells beyond the cut go by a join on the group and cell, and
    numbers in the cell at the cut tell the rest, in the same pass.
    """
    largest = quotas.agg(F.max("n" if "n" in quotas.columns else "quota")).first()[0] or 1
    digits = 2 + max(0, math.ceil(math.log(max(1, largest / cell_rows / 256), 16)))
    cell = F.substring(order, 1, digits)
    wanted = quotas.filter(F.col("quota") > 0).select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("quota").alias("__quota"))
    of_group = functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    held = rows.groupBy(*keys, cell.alias("__cell")).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__cell"))
    state = held.withColumn("__before", upto - F.col("__n")).join(wanted, of_group).filter(F.col("__before") < F.col("__quota"))
    state = state.select(*(f"__{k}" for k in keys), F.col("__cell").alias("__at"), (F.col("__quota") - F.col("__before")).alias("__left"))
    marked = rows.withColumn("__cell", cell).join(state, of_group & (F.col("__cell") == F.col("__at")))
    rank = F.row_number().over(Window.partitionBy(*keys, "__cell").orderBy(order))
    return marked.withColumn("__rank", rank).filter(F.col("__rank") <= F.col("__left")).select(*rows.columns)


def keyed_order(seed: int, *keys: str):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def sample_pairs(rows: DataFrame, *, token: str, source: str, key: str, most: int | None, strength: float, seed: int, mode: str = "off", chosen: str | None = None, min_chosen: int = 1) -> DataFrame:
    """Regularised sample of at most ``most`` rows, then balanced sources (``off``, ``sqrt`` or ``equal``).

    With ``most`` no smaller than the rows there are, all are kept: regularisation matters only under a cap.
    """
    if mode not in MODES:
        raise ValueError(f"source balance must be one of {', '.join(MODES)}, not {mode!r}")
    if chosen is not None:
        rows = rows.filter(F.when(F.col(chosen).isNull(), 0).otherwise(F.size(chosen)) >= min_chosen)
    matrix, path = count_matrix(rows, token, source)
    spark, paths = rows.sparkSession, [path]
    n = matrix.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    target = min(most or n, n)
    ordered = rows.withColumn("__order", keyed_order(seed, key))
    if target < n:
        quotas = nested_quotas(matrix, token, source, target, strength).select(token, source, "n", F.col("take").alias("quota"))
        ordered = take_per_group(ordered, [token, source], quotas, "__order")
        if mode != "off":
            ordered, _ = stored(ordered)  # at most the target's rows; it is read as long as the result is
            matrix, path = count_matrix(ordered, token, source)
            paths.append(path)
    if mode != "off":
        caps, path = stored(caps_of(matrix.groupBy(source).agg(F.sum("n").alias("n")), source, mode))
        caps = spark.createDataFrame(caps.collect(), caps.schema)  # a row a source
        paths.append(path)
        ordered = take_per_group(ordered, [source], caps, "__order")
    for path in paths:
        drop_path(spark, path)
    return ordered.drop("__order")


def source_caps(rows: DataFrame, source: str, mode: str) -> DataFrame:
    """source, n, quota: an equal part of all rows for each source, or one in proportion to the root of its rows."""
    return caps_of(rows.groupBy(source).agg(F.count("*").alias("n")), source, mode)


def caps_of(counts: DataFrame, source: str, mode: str) -> DataFrame:
    """``source_caps`` of (source, n)."""
    total = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("sources"), F.sum(F.sqrt("n")).alias("roots"))
    cap = F.floor(F.col("rows") / F.col("sources")) if mode == "equal" else F.floor(F.round(F.col("rows") * F.sqrt("n") / F.col("roots"), 9))
    return counts.join(F.broadcast(total)).select(source, "n", cap.cast("bigint").alias("quota"))  # total is one row


def balance_sources(rows: DataFrame, source: str, mode: str, order: str) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"source balance must be one of {', '.join(MODES)}, not {mode!r}")
    return rows if mode == "off" else take_per_group(rows, [source], source_caps(rows, source, mode), order)
