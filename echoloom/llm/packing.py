"""Packing documents into batches by optimal length buckets.

The histogram of the exact lengths over all rows goes to the driver: one entry a distinct length, so its size is
bounded by the longest text and not by the rows. Dynamic programming over it, by divide and conquer, chooses the
bucket boundaries with the least padding. In a bucket, rows are numbered across tasks (numbers
within hashed shards, plus the counts of the shards before), and consecutive rows form batches of as many rows as
the token budget holds at the bucket's length. No row is cut or dropped: one that is longer than the budget is
a batch of its own.

Null texts have length 0. Rows of one id are packed each. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, operator


def text_tokens(text_col: str = "text"):
    """Whitespace-delimited words as tokens, counted in the JVM."""
    return F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(r"\S+")), F.lit(0)).cast("bigint")


def choose_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The largest lengths of at most ``buckets`` buckets that pad the fewest tokens; lengths ascend.

    The first best split never falls as the last length rises, so each half of the lengths searches its part of the splits.
    """
    m = len(lengths)
    if not m:
        return []
    upto = np.concatenate(([0.0], np.cumsum(counts, dtype=float)))
    best = lengths * upto[1:]  # padded tokens of one bucket up to j
    splits = []
    for _ in range(1, min(buckets, m)):
        new, split = best.copy(), np.full(m, -1)
        todo = [(1, m - 1, 0, m - 2)]
        while todo:
            first, last, low, high = todo.pop()
            if first > last:
                continue
            j = (first + last) // 2
            until = min(j - 1, high)
            cost = best[low : until + 1] + lengths[j] * (upto[j + 1] - upto[low + 1 : until + 2])
            i = low + int(cost.argmin())
            if cost[i - low] < new[j]:
                new[j], split[j] = cost[i - low], i
            todo += [(first, j - 1, low, i), (j + 1, last, i, high)]
        splits.append(split)
        best = new
    out, j = [], m - 1
    for split in reversed(splits):
        if split[j] >= 0:
            out.append(int(lengths[j]))
            j = int(split[j])
    out.append(int(lengths[j]))
    return sorted(out)


def length_histogram(rows: DataFrame, length: str = "length") -> tuple[np.ndarray, np.ndarray]:
    got = rows.groupBy(F.col(length).alias("top")).agg(F.count("*").alias("n")).orderBy("top").collect()
    return np.array([r["top"] for r in got], np.int64), np.array([r["n"] for r in got], np.int64)


@operator
def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16, batch_tokens: int = 65_536, shard_rows: int = 2_000, keep: list[str] | None = None) -> DataFrame:
    """Per row: id, length, bucket, padded_length, batch (its number in the bucket) and slot; ``keep`` adds columns."""
    kept = [c for c in (keep or []) if c != id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), *(F.col(f"`{c}`").alias(f"__k{k}") for k, c in enumerate(kept)), text_tokens(text_col).alias("__length"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("__h"))
    rows = cut(rows)  # texts are read once; what is kept is a few numbers a row
    tops, counts = length_histogram(rows.select(F.col("__length").alias("length")))
    boundaries = choose_boundaries(tops, counts, buckets) or [0]
    owner = np.searchsorted(boundaries, tops)
    sizes = [int(counts[owner == k].sum()) for k in range(len(boundaries))]
    bucket = F.lit(len(boundaries) - 1)
    for k in reversed(range(len(boundaries) - 1)):
        bucket = F.when(F.col("__length") <= boundaries[k], F.lit(k)).otherwise(bucket)
    shards = F.array(*(F.lit(-(-s // shard_rows) or 1) for s in sizes))
    rows = rows.withColumn("__bucket", bucket.cast("int")).withColumn("__shard", F.pmod(F.col("__h"), F.get(shards, F.col("__bucket"))))
    held = rows.groupBy("__bucket", "__shard").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("__bucket").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.withColumn("__before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("__bucket", "__shard", "__before")
    number = F.row_number().over(Window.partitionBy("__bucket", "__shard").orderBy("__h", "__id", "__length"))
    numbered = rows.withColumn("__n", number).join(offsets, ["__bucket", "__shard"]).withColumn("__n", F.col("__n") + F.col("__before") - 1)
    padded = F.get(F.array(*(F.lit(b).cast("bigint") for b in boundaries)), F.col("__bucket"))
    held_rows = F.greatest(F.floor(F.lit(batch_tokens) / F.greatest(padded, F.lit(1))), F.lit(1))
    return numbered.select(
        F.col("__id").alias(id_col),
        *(F.col(f"__k{k}").alias(c) for k, c in enumerate(kept)),
        F.col("__length").alias("length"),
        F.col("__bucket").alias("bucket"),
        padded.alias("padded_length"),
        F.floor(F.col("__n") / held_rows).cast("bigint").alias("batch"),
        (F.col("__n") % held_rows).cast("bigint").alias("slot"),
    )
