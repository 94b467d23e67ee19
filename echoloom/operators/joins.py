"""As-of joins (the previous or next row of a key within a tolerance) and interval joins (the spans that hold a point).

Neither compares all rows of a key. An as-of join is a union of both sides, a sort and a running last value, in the
JVM. A key whose rows are too many for a task is cut in cells of places: each cell gets what is before it as one row
more, from the cells' own last rows. An interval join sends spans and points to bins: a span goes to bins that are at
least as wide as itself, of a width that is a power of two times the narrowest, so it has at most two copies, and a
point is copied once for each width that any span has. Bins with very many points are dealt in salted parts.

Null keys and null places match nothing. Rows with equal places match each other unless ``strict``. Empty sides give
no matches. Equal rows are joined each.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN = "__join"
# The order of rows at one place: what a cell is told, right rows that match, left rows, right rows that don't.
_TOLD, _BEFORE, _LEFT, _AFTER = range(4)


def _place(df: DataFrame, name: str, whole: Column | None = None) -> Column:
    """A place, or that in a struct of the frame's row, as a number: microseconds of times, days of dates."""
    kind, value = df.schema[name].dataType, F.col(f"`{name}`") if whole is None else whole.getField(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp"))
    return F.unix_date(value).cast("bigint") if isinstance(kind, T.DateType) else value


def _number(x: float | timedelta | None) -> float | None:
    return x // timedelta(microseconds=1) if isinstance(x, timedelta) else x


def _taken(names: list[str]) -> str:
    """A beginning that no given column has."""
    own = _OWN
    while any(n.startswith(own) for n in names):
        own += "_"
    return own


def asof_join(
    left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, *, direction: str = "backward", strict: bool = False,
    tolerance: float | timedelta | None = None, cell: float | timedelta | None = None, name: str = "match",
) -> DataFrame:
    """The left rows with ``name``: the row of the right side, as a struct, with the same keys and the nearest place at
    or before the left one (``backward``), at or after it (``forward``), or either (``nearest``, before if as near), no
    further than ``tolerance``; null without one.

    Of right rows at one place the greatest in the order of their columns matches. ``cell`` is the width of the cells
    that a key is cut in; without it a key is one task's. Places are numbers, dates (tolerance in days) or times.
    """
    if direction == "nearest":
        own = _taken(left.columns)
        both = asof_join(left, right, on, left_at, right_at, strict=strict, tolerance=tolerance, cell=cell, name=f"{own}_b")
        both = asof_join(both, right, on, left_at, right_at, direction="forward", strict=strict, tolerance=tolerance, cell=cell, name=f"{own}_f")
        back, ahead = (F.col(f"{own}_{x}") for x in "bf")
        behind, before = _place(left, left_at) - _place(right, right_at, back), _place(right, right_at, ahead) - _place(left, left_at)
        return both.withColumn(name, F.when(ahead.isNull() | (behind <= before), back).otherwise(ahead)).drop(f"{own}_b", f"{own}_f")
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction must be backward, forward or nearest, not {direction!r}")
    sign = 1 if direction == "backward" else -1
    tolerance, cell = _number(tolerance), _number(cell)
    own = _taken([*left.columns, *right.columns])
    key, place, order, kind, row, other, part = (f"{own}_{x}" for x in ("key", "place", "order", "kind", "row", "other", "cell"))
    broken = any(isinstance(d.schema[c].dataType, T.FractionalType) for d, c in ((left, left_at), (right, right_at)))
    number = "double" if broken else "bigint"
    no_left, no_right = (F.lit(None).cast(x.schema) for x in (left, right))

    def side(df: DataFrame, at: str, rank: int) -> DataFrame:
        whole, p = F.struct(*(F.col(f"`{c}`") for c in df.columns)), _place(df, at).cast(number)
        columns = [F.struct(*(F.col(f"`{c}`") for c in on)).alias(key), p.alias(place), (sign * p).alias(order), F.lit(rank).alias(kind)]
        rows = df.select(*columns, (whole if df is left else no_left).alias(row), (no_right if df is left else whole).alias(other))
        return rows.withColumn(part, F.floor(F.col(order) / cell) if cell else F.lit(0).cast("bigint"))

    there = right.filter(F.col(f"`{right_at}`").isNotNull())
    for c in on:
        there = there.filter(F.col(f"`{c}`").isNotNull())
    lefts = side(left, left_at, _LEFT)
    rights = side(there, right_at, _AFTER if strict else _BEFORE)
    every = lefts.unionByName(rights)
    if cell:
        # the last right row of each cell, told to the next cells that have left rows
        tops = rights.groupBy(key, part).agg(F.max(F.struct(order, other)).alias("top")).select(key, part, F.col(f"top.{other}").alias("top"), F.lit(False).alias("asks"))
        asks = lefts.filter(F.col(place).isNotNull()).select(key, part).distinct().select(key, part, no_right.alias("top"), F.lit(True).alias("asks"))
        earlier = Window.partitionBy(key).orderBy(part).rangeBetween(Window.unboundedPreceding, -1)
        told = tops.unionByName(asks).withColumn(other, F.last("top", ignorenulls=True).over(earlier)).filter(F.col("asks") & F.col(other).isNotNull())
        nowhere = F.lit(None).cast(number)
        every = every.unionByName(told.select(key, nowhere.alias(place), nowhere.alias(order), F.lit(_TOLD).alias(kind), no_left.alias(row), other, part))
    # left rows without a place come before anything that they could match, then what the cell is told
    first = F.when(F.col(kind) == _TOLD, 1).when(F.col(order).isNull(), 0).otherwise(2)
    upto = Window.partitionBy(key, part).orderBy(first, order, kind, other).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = every.withColumn(other, F.last(other, ignorenulls=True).over(upto)).filter(F.col(kind) == _LEFT)
    match = F.col(other)
    if tolerance is not None:
        match = F.when(F.abs(_place(right, right_at, match) - F.col(place)) <= tolerance, match)
    return found.select(*(F.col(f"{row}.`{c}`").alias(c) for c in left.columns), match.alias(name))


def interval_join(
    points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str, *, narrowest: float = 64, hot_rows: int = 100_000, how: str = "inner"
) -> DataFrame:
    """Points with the spans that hold them: start <= at < end, and equal keys. Columns of the points, then those of the
    spans but for the keys. ``how`` is inner, or left to keep points in no span. Places are numbers.

    ``narrowest`` is the width of the narrowest bins. Bins with more than ``hot_rows`` points and more than a 2,000th of
    all, so less than 2,000 bins, are dealt in parts of about that many by a hash of the point; their spans are copied.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    own = _taken([*points.columns, *spans.columns])
    level, bin_, salt, parts = (f"{own}_{x}" for x in ("level", "bin", "salt", "parts"))
    here, a, b = F.col(f"`{at}`"), F.col(f"`{start}`"), F.col(f"`{end}`")
    width = F.lit(float(narrowest)) * F.pow(F.lit(2.0), F.col(level))
    held = spans.filter(a < b).withColumn(level, F.ceil(F.log2(F.greatest((b - a).cast("double") / narrowest, F.lit(1.0)))).cast("int"))
    levels = sorted(r[0] for r in held.select(level).distinct().collect())  # powers of two: less than 2,100
    held = held.withColumn(bin_, F.explode(F.sequence(F.floor(a / width), F.floor(b / width))))
    asked = points.filter(here.isNotNull()).withColumn(level, F.explode(F.lit(levels).cast("array<int>"))).withColumn(bin_, F.floor(here / width))
    keys = [*on, level, bin_]
    counts = asked.groupBy(*keys).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    edge = max(hot_rows, total // 2000)
    if total > edge:
        hot = F.broadcast(counts.filter(F.col("n") > edge).select(*keys, F.ceil(F.col("n") / edge).alias(parts)))
        n = F.coalesce(parts, F.lit(1).cast("bigint"))
        asked = asked.join(hot, keys, "left").withColumn(salt, F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in points.columns)), n))
        held = held.join(hot, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
        asked, held, keys = asked.drop(parts), held.drop(parts), [*keys, salt]
    rest = [c for c in spans.columns if c not in on]
    met = asked.join(held.select(*keys, *(F.col(f"`{c}`") for c in rest)), keys)
    found = met.filter((a <= here) & (here < b)).select(*(F.col(f"`{c}`") for c in [*points.columns, *rest]))
    if how == "inner":
        return found
    none = points.join(found.select(*on, at).distinct(), [*on, at], "left_anti")
    return found.unionByName(none, allowMissingColumns=True)
