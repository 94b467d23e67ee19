"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its share of all tokens to the power of an exponent, normalised. Bisection (256 ways a turn, each
turn one grouped sum over the sources) finds the exponent that meets a target entropy, as a share of the largest
possible, or, if larger, the one that keeps every source within a limit of repetition under the token budget. A
source's quota is its weight times the budget. Each pass over a source is a block: a permutation of all its documents
of its own, keyed by the pass, and the last block is cut where the quota ends. So a document has as many copies as
whole passes, plus one if it stands before the cut in the order of the last. A quota within a billionth of a whole
number of passes counts as that number.

The cut is found without bringing a source's rows together: the space of places is searched in steps of 8 bits, each
a grouped sum of at most 256 rows a source, and only the last cell's documents are ordered. Positions in a source's
sequence of blocks come from counts of cells of about ``CELL_ROWS`` rows and numbers within them.

The plan is a table of one row a source. That of the ``MOST_SOURCES`` sources with most rows is broadcast; rows of any
further ones, none of which holds more than a 10,000th of the rows, meet theirs in a shuffled join.

A null source is a source of its own; documents without tokens (null or empty texts) are copied with their pass, and
a source without tokens is taken once. Equal rows stand at one place of a permutation and go together. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_stored, operator, store
from .packing import text_tokens

MOST_SOURCES = 10_000
CELL_ROWS = 2_000
_BITS = 48

#: The sums of u ** a and of u ** a * ln(u) over the sources' shares u, for each exponent a.
Sums = Callable[[list[float]], list[tuple[float, float]]]


def entropy(sums: tuple[float, float], exponent: float) -> float:
    """The entropy of the weights u ** a / sum(u ** a)."""
    z, log = sums
    return math.log(z) - exponent * log / z


def choose_exponent(sums: Sums, sources: int, smallest: float, budget_share: float, target_entropy: float | None, most_repeats: float | None, ways: int = 256, turns: int = 5) -> float:
    """The smallest exponent from 0 (uniform) to 1 (natural) that meets both aims; 1 if none does.

    Entropy and the repetition of the smallest source, with the share ``smallest``, fall as it rises.
    """
    if sources < 2:
        return 1.0
    aims = []
    if target_entropy is not None:
        aims.append(lambda s, a: entropy(s, a) <= target_entropy * math.log(sources) + 1e-12)
    if most_repeats is not None:
        aims.append(lambda s, a: smallest ** (a - 1) * budget_share / s[0] <= most_repeats * (1 + 1e-12))
    spans = [(0.0, 1.0)] * len(aims)
    for _ in range(turns if aims else 0):
        grids = [[low + (high - low) * k / ways for k in range(ways + 1)] for low, high in spans]
        got = iter(sums([a for grid in grids for a in grid]))
        for n, (grid, aim) in enumerate(zip(grids, aims, strict=True)):
            held = [aim(next(got), a) for a in grid]
            first = held.index(True) if any(held) else ways
            spans[n] = (grid[max(0, first - 1)], grid[first])
    return max((high for _, high in spans), default=0.0)


def _sums(totals: DataFrame, total: int) -> Sums:
    share = totals.filter("tokens > 0").select((F.col("tokens") / F.lit(float(total))).alias("u"))

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        each = share.select("u", F.posexplode(F.lit(exponents)).alias("k", "a")).select("k", "u", F.pow("u", "a").alias("w"))
        got = {r["k"]: (r["z"], r["log"]) for r in each.groupBy("k").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("u")).alias("log")).collect()}
        return [got[k] for k in range(len(exponents))]

    return sums


def _key(source: Column) -> Column:
    """The source as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _named(key: str) -> Column:
    return F.when(F.col(key) != "", F.substring(F.col(key), 2, 1 << 30))


def _place(seed: int, number: Column, row: Column) -> Column:
    """A row's place in the permutation of a pass: 48 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), number.cast("int"), row), 64 - _BITS)


def _row_hash(id_col: str, source_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{source_col}`").cast("string"), F.col(f"`{text_col}`"))


def mixture_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A few numbers a row: id, source (its key), h (the row's hash) and tokens."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), _key(F.col(f"`{source_col}`")).alias("source"), _row_hash(id_col, source_col, text_col).alias("h"), text_tokens(text_col).alias("tokens"))


def _told(rows: DataFrame, key: Column, plan: DataFrame, most: int) -> DataFrame:
    """The rows with the plan of their source; the plan's first columns are the source's key and its number of rows."""
    of, docs = plan.columns[:2]
    if plan.count() <= most:
        return rows.join(F.broadcast(plan), key == F.col(of))
    edge = plan.orderBy(F.desc(docs)).limit(most + 1).agg(F.min(docs)).first()[0]
    head, tail = plan.filter(F.col(docs) > edge), plan.filter(F.col(docs) <= edge)  # the head has at most ``most`` sources
    rest = rows.join(F.broadcast(head.select(of)), key == F.col(of), "left_anti")
    return rows.join(F.broadcast(head), key == F.col(of)).unionByName(rest.join(tail, key == F.col(of)))


def plan_mixture(rows: DataFrame, *, target_entropy: float | None = 0.9, most_repeats: float | None = 2.0, budget_share: float = 1.0, seed: int = 5, most_sources: int = MOST_SOURCES) -> DataFrame:
    """For each source of ``mixture_rows``: of (its key), tokens, docs, weight, exponent, passes (whole ones) and cut,
    the last place of the pass after them. The budget is a share of all tokens."""
    totals = cut(rows.groupBy(F.col("source").alias("of")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    total, smallest, sources = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.min(F.when(F.col("tokens") > 0, F.col("tokens"))), F.count_if(F.col("tokens") > 0)).first()
    total, smallest = max(1, total), smallest or 1
    sums = _sums(totals, total)
    exponent = choose_exponent(sums, sources, smallest / total, budget_share, target_entropy, most_repeats)
    z = sums([exponent])[0][0] if sources else 1.0
    some = F.col("tokens") > 0
    planned = totals.withColumn("weight", F.when(some, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(exponent)) / F.lit(z)).otherwise(F.lit(0.0)))
    planned = planned.withColumn("exponent", F.lit(exponent)).withColumn("quota", F.col("weight") * F.lit(float(budget_share * total)))
    planned = planned.withColumn("passes", F.when(some, F.floor(F.col("quota") / F.col("tokens") + 1e-9)).otherwise(1).cast("int"))
    planned = cut(planned.withColumn("rest", F.greatest(F.lit(0.0), F.col("quota") - F.col("passes") * F.col("tokens"))))
    state = planned.filter(some).select("of", "docs", "passes", "rest", F.lit(0).cast("bigint").alias("low"))
    light = rows.select("source", "h", "tokens")
    upto = F.sum("tokens").over(Window.partitionBy("of").orderBy("cell"))

    def cells(shift: int, known: int) -> DataFrame:
        """Tokens by cells of places that agree with ``low`` above the bit ``known``."""
        place = _place(seed, F.col("passes") + 1, F.col("h"))
        here = _told(light, F.col("source"), state, most_sources).withColumn("place", place)
        here = here.filter(F.shiftrightunsigned("place", known) == F.shiftrightunsigned("low", known)) if known < _BITS else here
        return here.groupBy("of", "docs", "passes", "rest", "low", F.shiftrightunsigned("place", shift).alias("cell")).agg(F.sum("tokens").alias("tokens"))

    for shift in (_BITS - 8, _BITS - 16, _BITS - 24):  # the rest is less than all tokens, so it ends in some cell
        past = cells(shift, shift + 8).withColumn("upto", upto).filter(F.col("upto") > F.col("rest"))
        first = past.groupBy("of", "docs", "passes").agg(F.min(F.struct("cell", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("rest"))).alias("x"))
        state = cut(first.select("of", "docs", "passes", F.col("x.rest").alias("rest"), F.shiftleft("x.cell", shift).alias("low")))
    last = cells(0, _BITS - 24).withColumn("upto", upto)
    cuts = last.groupBy("of").agg(F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("cell"))), F.min("low") - 1).alias("cut"))
    joined = planned.join(cuts, "of", "left").select("of", "tokens", "docs", "weight", "exponent", "passes", F.coalesce("cut", F.lit(-1)).alias("cut"))
    return cut(joined)


def _passes(passes: Column, last: Column) -> Column:
    """The numbers of a row's passes, as an array."""
    n = passes + last.cast("int")
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


@operator
def draws(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 5, most_sources: int = MOST_SOURCES, **options) -> DataFrame:
    """Per copy of a row in the mixture: id, source, n_tokens, pass (from 1) and position, its number in the source's
    sequence of blocks (from 1). Texts are read once and not shuffled."""
    rows, at = store(mixture_rows(docs, id_col=id_col, text_col=text_col, source_col=source_col))
    plan = plan_mixture(rows, seed=seed, most_sources=most_sources, **options)
    copies = F.col("passes") + 1
    each = _told(rows, F.col("source"), plan.select("of", "docs", "passes", "cut"), most_sources)
    each = each.withColumn("pass", F.explode(_passes(F.col("passes"), _place(seed, copies, F.col("h")) <= F.col("cut"))))
    bits = F.greatest(F.ceil(F.log2(F.col("docs") / CELL_ROWS)), F.lit(0))
    each = each.withColumn("place", _place(seed, F.col("pass"), F.col("h")))
    each = each.withColumn("cell", F.floor(F.col("place") / F.pow(F.lit(2.0), _BITS - bits)))
    held = each.groupBy("of", "pass", "cell").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("of", "pass").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("of", "pass", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("of", "pass", "cell").orderBy("place", "id", "tokens"))
    numbered = each.withColumn("number", number).join(offsets, ["of", "pass", "cell"])
    position = (F.col("pass") - 1) * F.col("docs") + F.col("before") + F.col("number")
    out = cut(numbered.select(F.col("id").alias(id_col), _named("of").alias("source"), F.col("tokens").alias("n_tokens"), "pass", position.cast("bigint").alias("position")))
    drop_stored(docs.sparkSession, at)
    return out


@operator
def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 5, most_sources: int = MOST_SOURCES, **options) -> DataFrame:
    """The rows of the mixture with the columns of ``docs``, one row a copy. A map over the rows with the plan of each
    source; texts are not shuffled."""
    rows, at = store(mixture_rows(docs, id_col=id_col, text_col=text_col, source_col=source_col))
    plan = plan_mixture(rows, seed=seed, most_sources=most_sources, **options)
    drop_stored(docs.sparkSession, at)
    own = "__mixture"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    plan = plan.select("of", "docs", "passes", "cut").toDF(*(f"{own}_{c}" for c in ("of", "docs", "passes", "cut")))
    told = _told(docs, _key(F.col(f"`{source_col}`")), plan, most_sources)
    passes = F.col(f"{own}_passes")
    last = _place(seed, passes + 1, _row_hash(id_col, source_col, text_col)) <= F.col(f"{own}_cut")
    given = [F.col(f"`{c}`") for c in docs.columns]
    return told.select(*given, F.explode(_passes(passes, last)).alias(own)).select(*given)
