"""Training features of preference pairs: a cascade of filters with the first reason to reject, and token ids."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytelevel import sliced
from ..functions.scalar import is_stop_word, is_trimmed, let, normal_key

#: A row's chosen tokens are thinned only from this many on, above this percentile of their counts.
LEAST_CHOSEN, PERCENTILE = 50, 0.95


def drop_trimmed(pairs: DataFrame, prompt: str = "source_prompt") -> tuple[DataFrame, DataFrame]:
    """The rows whose prompt was not trimmed, and a one-row frame with how many were."""
    return pairs.filter(~is_trimmed(prompt)), pairs.agg(F.count_if(is_trimmed(prompt)).alias("n_dropped"))


def encoder(encode: Callable[[], Callable[[str], list[int]]]) -> Callable[[Column], Column]:
    """A tokenizer as a column function: ``encode`` builds it in the worker, which maps text to ids."""

    def apply(texts: Column) -> Column:
        @F.arrow_udf("array<array<bigint>>")
        def run(a: pa.Array) -> pa.Array:
            f, known = encode(), {}

            def ids(t):
                if len(t) > 64:
                    return f(t)
                if t not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known[t] = f(t)
                return known[t]

            return sliced(lambda a: pa.array([None if x is None else [ids(t or "") for t in x] for x in a.to_pylist()], pa.list_(pa.list_(pa.int64()))), a)

        return run(texts)

    return apply


def reject_reason(*, context: Column, length: Column, max_length: int, rejected_raw: Column, rejected_ids: Column, rejected_decoded: Column, chosen: Column, chosen_single: Column, stop_words: bool) -> Column:
    """The first filter that a pair fails, null if it passes all."""
    reason = F.when(F.coalesce(context, F.lit("")) == "", "empty_context").when(length + 1 > max_length, "over_length").when(F.coalesce(rejected_raw, F.lit("")) == "", "no_rejected").when(F.coalesce(rejected_ids, F.lit(0)) != 1, "rejected_not_single")
    if stop_words:
        reason = reason.when(is_stop_word(F.coalesce(rejected_decoded, F.lit(""))), "rejected_stopword")
    none = F.when(chosen.isNull(), 0).otherwise(F.size(chosen))
    return reason.when(none < 1, "no_chosen").when(F.coalesce(chosen_single, F.lit(0)) < 1, "chosen_not_single")


def thin_chosen(chosen: Column, least: int = LEAST_CHOSEN, percentile: float = PERCENTILE) -> Column:
    """Of (id, decoded) structs, those whose key is not among the most frequent of the row; all if none is left."""
    def counted(xs):
        keys = F.transform(xs, lambda x: normal_key(x["decoded"]))
        each = let(keys, lambda ks: F.transform(ks, lambda k: F.size(F.filter(ks, lambda o: o == k))))
        once = let(keys, lambda ks: F.array_sort(F.transform(F.array_distinct(ks), lambda k: F.size(F.filter(ks, lambda o: o == k)))))
        return F.struct(xs.alias("xs"), each.alias("each"), once.alias("once"))

    def limited(s):
        place = (F.size(s["once"]) - 1) * F.lit(percentile)
        low, high = F.get(s["once"], F.floor(place).cast("int")), F.get(s["once"], F.ceil(place).cast("int"))
        return F.struct(s["xs"].alias("xs"), s["each"].alias("each"), (low + (high - low) * (place - F.floor(place))).alias("limit"))

    def kept(s):
        few = F.filter(F.zip_with(s["xs"], s["each"], lambda x, n: F.struct(x.alias("x"), n.alias("n"))), lambda z: z["n"] <= s["limit"])
        return F.when(F.size(few) == 0, s["xs"]).otherwise(F.transform(few, lambda z: z["x"]))

    return F.when((F.size(chosen) < least) | (F.size(chosen) <= 1), chosen).otherwise(let(let(let(chosen, counted), limited), kept))


def tokenise(pairs: DataFrame, encode: Callable[[], Callable[[str], list[int]]], *, max_length: int = 4096, stop_words: bool = True, chosen_strength: float = 0.0, begin: list[int] | None = None) -> DataFrame:
    """The pairs with reject_reason, prompt_ids, rejected_token_id, chosen_ids and chosen_decoded.

    Chosen tokens of several ids go one by one, with their texts, so ids and texts stay side by side.
    """
    ids = encoder(encode)
    raw = F.coalesce("multi_chosen_tokens", F.array().cast("array<string>"))
    rows = pairs.withColumn("__ids", ids(F.concat(F.array(F.coalesce("context_before", F.lit("")), F.coalesce("rejected_token", F.lit(""))), raw)))
    rows = rows.withColumn("prompt_ids", F.concat(F.lit(begin or []).cast("array<bigint>"), F.get("__ids", F.lit(0)))).withColumn("__rejected", F.get("__ids", F.lit(1)))
    zipped = F.zip_with(F.slice("__ids", F.lit(3), F.greatest(F.size("__ids"), F.lit(1))), F.coalesce("multi_chosen_decoded", F.array().cast("array<string>")), lambda i, d: F.struct(i.alias("ids"), d.alias("decoded")))
    single = F.transform(F.filter(zipped, lambda x: F.size(x["ids"]) == 1), lambda x: F.struct(F.get(x["ids"], F.lit(0)).alias("id"), F.coalesce(x["decoded"], F.lit("")).alias("decoded")))
    rows = rows.withColumn("__chosen", single)
    reason = reject_reason(context=F.col("context_before"), length=F.size("prompt_ids"), max_length=max_length, rejected_raw=F.col("rejected_token"), rejected_ids=F.size("__rejected"), rejected_decoded=F.col("rejected_decoded"), chosen=F.col("multi_chosen_tokens"), chosen_single=F.size("__chosen"), stop_words=stop_words)
    kept = thin_chosen(F.col("__chosen")) if chosen_strength > 0 else F.col("__chosen")
    rows = rows.withColumn("reject_reason", reason).withColumn("__chosen", kept)
    rows = rows.withColumn("rejected_token_id", F.get("__rejected", F.lit(0))).withColumn("chosen_ids", F.transform("__chosen", lambda x: x["id"])).withColumn("chosen_decoded", F.transform("__chosen", lambda x: x["decoded"]))
    return rows.drop("__ids", "__rejected", "__chosen")


def filter_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def pad_left(ids: Column, length: int, pad: int) -> Column:
    """Ids padded on the left; too long ones are an error, never cut."""
    checked = F.when(F.size(ids) + 1 > length, F.raise_error(F.lit("a sample is longer than the maximum length"))).otherwise(ids)
    return F.concat(F.array_repeat(F.lit(pad).cast("bigint"), F.lit(length) - F.size(checked)), checked)


def position_ids(size: Column, length: int) -> Column:
    """Of left-padded ids: 0 in the padding, then 0, 1, 2, ..."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.greatest(i - (F.lit(length) - size), F.lit(0)))
