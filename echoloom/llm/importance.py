"""Importance resampling of documents towards a target corpus, by bucket-partitioned inverted postings.

Features are all runs of 1 to ``longest`` consecutive words, with repeats; a feature's bucket is its crc32 modulo
``BUCKETS``. A bucket's gain compares its smoothed share of the target's features with its share of the documents', and
a document's weight is the sum of the gains of its features. Keyed Gumbel noise on top makes the highest scores a
draw without replacement, with probabilities by the exponent of the weights.

The stages:

1. Scan tasks read whole texts and write blocks of documents, inverted: for each of ``PARTS`` ranges of buckets the
   postings (document, bucket, count) of the block, packed in bytes, and per task the sums of each bucket. The crc of a
   longer run continues that of the run before it, so features are never built as texts.
2. Postings are shuffled by (range, salt) and co-grouped with the sums of that range in both corpora; there each bucket's
   gain is computed, and each block gives a document's contribution from the range. A range has as many salts as keep
   its postings in ``GROUP_BYTES`` bytes, so tasks grow with the corpus though the buckets don't.
3. Contributions are summed by document.
4. Scores are sorted by ranges, and a row's rank is its place in its range behind the rows of the ranges before.

Null texts count as empty; documents without words have no features and the weight 0. A null id draws its noise from
the empty text and comes last among equal scores. Repeated rows are documents each; equal ones take ranks in any order.
Very long texts are read whole, and a block ends after ``BLOCK_FEATURES`` features. Without a target all
buckets are compared with nothing. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_stored, map_stream, operator, partitions, store

BUCKETS, PARTS = 10_000, 50
SLOTS = BUCKETS // PARTS  # buckets of a range: less than 256, so a place is a byte
BLOCK_ROWS, BLOCK_FEATURES = 512, 1 << 20
GROUP_BYTES = 24 << 20
_WORDS = bytes(x | 0x20 if 0x41 <= x <= 0x5A else x if x >= 0x80 or 0x61 <= x <= 0x7A or 0x30 <= x <= 0x39 else 0x20 for x in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters above ASCII, with A-Z in lower case."""
    return text.translate(_WORDS).split() if text else []


def feature_hashes(words: list[bytes], longest: int = 3) -> np.ndarray:
    """The crc32 of every run of 1 to ``longest`` words joined by one space."""
    if not words:
        return np.empty(0, np.uint32)
    spaced = [b" " + w for w in words]
    runs = [list(map(crc32, words))]
    for k in range(1, longest):
        runs.append(list(map(crc32, spaced[k:], runs[-1])))  # shorter by one: the last run has no word after it
    return np.concatenate([np.array(r, np.uint32) for r in runs])


def _pack(slots: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Places as differences modulo 256, counts as bytes or wider numbers, postings a document; compressed."""
    press = zstandard.ZstdCompressor(level=1).compress
    kind = np.min_scalar_type(int(counts.max()) if len(counts) else 0)
    return press(np.diff(slots, prepend=np.uint8(0)).tobytes()), press(counts.astype(kind).tobytes()), press(docs.astype(np.uint16).tobytes())


def _unpack(slots: bytes, counts: bytes, docs: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document, place and count of each posting."""
    out = zstandard.ZstdDecompressor().decompress
    place = np.cumsum(np.frombuffer(out(slots), np.uint8), dtype=np.uint8)
    raw, of = out(counts), np.frombuffer(out(docs), np.uint16)
    count = np.frombuffer(raw, f"u{len(raw) // len(place)}").astype(np.int64) if len(place) else np.empty(0, np.int64)
    return np.repeat(np.arange(len(of)), of), place, count


def postings(docs: DataFrame, id_col: str | None, text_col: str, longest: int = 3) -> DataFrame:
    """Rows of three kinds: a block's documents (``ids``, ``words``, ``features``); a block's postings of a range
    (``part``); a task's sums of a range (``sums``). Without ``id_col`` only sums."""
    given = F.col(f"`{id_col}`").cast("bigint") if id_col else F.lit(None).cast("bigint")
    rows = docs.select(given.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    nothing = {"block": None, "ids": None, "words": None, "features": None, "part": None, "slots": None, "counts": None, "docs": None, "sums": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        base, number = TaskContext.get().partitionId() << 36, 0
        sums = np.zeros(BUCKETS, np.int64)
        ids, words, features, found = [], [], [], []

        def block() -> Iterator[dict]:
            nonlocal number
            if id_col and ids:
                doc = np.repeat(np.arange(len(found)), [len(b) for b, _ in found])
                bucket = np.concatenate([b for b, _ in found]).astype(np.uint16)
                count = np.concatenate([c for _, c in found])
                part = bucket // SLOTS
                order = np.argsort(part, kind="stable")
                doc, bucket, count, part = doc[order], bucket[order], count[order], part[order]
                ends = np.searchsorted(part, np.arange(PARTS + 1))
                out = []
                for k in range(PARTS):
                    a, b = ends[k], ends[k + 1]
                    if a < b:
                        packed = _pack((bucket[a:b] - k * SLOTS).astype(np.uint8), count[a:b], np.bincount(doc[a:b], minlength=len(found)))
                        out.append({"block": base + number, "part": k} | dict(zip(("slots", "counts", "docs"), packed, strict=True)))
                out.append({"block": base + number, "ids": ids[:], "words": words[:], "features": features[:]})
                yield {c: [x.get(c) for x in out] for c in nothing}
                number += 1
            for x in (ids, words, features, found):
                x.clear()

        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                    w = words_of(text)
                    counted = np.bincount(feature_hashes(w, longest) % np.uint32(BUCKETS), minlength=BUCKETS)
                    at_buckets = np.flatnonzero(counted)
                    sums[at_buckets] += counted[at_buckets]
                    ids.append(i)
                    words.append(len(w))
                    features.append(int(counted.sum()))
                    found.append((at_buckets, counted[at_buckets]))
                    held += len(at_buckets)
                    if len(ids) >= BLOCK_ROWS or held >= BLOCK_FEATURES:
                        yield from block()
                        held = 0
        yield from block()
        some = [k for k in range(PARTS) if sums[k * SLOTS : (k + 1) * SLOTS].any()]
        if some:
            yield {c: [None] * len(some) for c in nothing} | {"part": some, "sums": [sums[k * SLOTS : (k + 1) * SLOTS] for k in some]}

    kind = "block bigint, ids array<bigint>, words array<bigint>, features array<bigint>, part int, slots binary, counts binary, docs binary, sums array<bigint>"
    return map_stream(rows, ["id", "text"], run, kind)


def _summed(rows: DataFrame, name: str) -> DataFrame:
    """The sums of each bucket over all tasks: part, slot and its sum."""
    each = rows.filter(F.col("sums").isNotNull()).select("part", F.posexplode("sums").alias("slot", "n"))
    return each.groupBy("part", "slot").agg(F.sum("n").alias(name))


def weights(docs: DataFrame, target: DataFrame, *, id_col: str, text_col: str, target_text_col: str, longest: int = 3) -> DataFrame:
    """Per row: id, n_words, n_features, weight (the sum of the gains of its features)."""
    spark = docs.sparkSession
    tasks = partitions(spark)
    posted, posted_at = store(postings(docs, id_col, text_col, longest))
    aimed = postings(target, None, target_text_col, longest)
    every = spark.range(BUCKETS).select(F.floor(F.col("id") / SLOTS).cast("int").alias("part"), F.pmod("id", F.lit(SLOTS)).cast("int").alias("slot"))
    both = every.join(_summed(posted, "s"), ["part", "slot"], "left").join(_summed(aimed, "t"), ["part", "slot"], "left").na.fill(0, ["s", "t"])
    both = cut(both)  # a row a bucket
    of_docs, of_target = both.agg(F.sum("s"), F.sum("t")).first()
    places = F.array_sort(F.collect_list(F.struct("slot", "s", "t")))  # SLOTS of them
    ranges = both.groupBy("part").agg(places.alias("x")).select("part", F.col("x.s").alias("s"), F.col("x.t").alias("t"))

    packed = posted.filter(F.col("slots").isNotNull()).select("block", "part", "slots", "counts", "docs")
    size = packed.agg(F.coalesce(F.sum(F.octet_length("slots") + F.octet_length("counts") + F.octet_length("docs")), F.lit(0))).first()[0]
    salts = max(1, -(-size // (PARTS * GROUP_BYTES)))
    keyed = packed.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    beside = ranges.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def contribute(left: pa.Table, right: pa.Table) -> pa.Table:
        block, out = [], []
        if right.num_rows:
            s, t = (np.array(right[c][0].as_py(), np.float64) for c in ("s", "t"))
            gain = np.floor(1000 * np.log((t + 1) * (of_docs + BUCKETS) / ((s + 1) * (of_target + BUCKETS)))).astype(np.int64)
            for b, *row in zip(*(left[c].to_pylist() for c in ("block", "slots", "counts", "docs")), strict=True):
                doc, place, count = _unpack(*row)
                total = np.zeros(int(doc[-1]) + 1 if len(doc) else 0, np.int64)
                np.add.at(total, doc, gain[place] * count)
                block.append(b)
                out.append(total)
        return pa.table({"block": pa.array(block, pa.int64()), "part_weights": pa.array(out, pa.list_(pa.int64()))})

    given = keyed.groupBy("part", "salt").cogroup(beside.groupBy("part", "salt")).applyInArrow(contribute, "block bigint, part_weights array<bigint>")
    none = [F.lit(None).cast("bigint").alias(c) for c in ("id", "words", "features")]
    told = given.select("block", F.posexplode("part_weights").alias("place", "weight"), *none)
    heads = posted.filter(F.col("ids").isNotNull()).select("block", F.posexplode(F.arrays_zip("ids", "words", "features")).alias("place", "x"))
    heads = heads.select("block", "place", F.lit(0).cast("bigint").alias("weight"), "x.ids", "x.words", "x.features").toDF(*told.columns)
    summed = told.unionByName(heads).groupBy("block", "place").agg(F.max("id").alias("id"), F.max("words").alias("n_words"), F.max("features").alias("n_features"), F.sum("weight").alias("weight"))
    out = cut(summed.repartition(tasks, "block", "place").select("id", "n_words", "n_features", "weight"))
    drop_stored(spark, posted_at)
    return out


def numbered(rows: DataFrame, order: list) -> tuple[DataFrame, str]:
    """The rows with their ``rank`` in an order, from one sort by ranges; and the folder that they are read from."""
    ordered, at = store(rows.orderBy(*order).withColumn("range", F.spark_partition_id()).withColumn("number", F.monotonically_increasing_id()))
    held = ordered.groupBy("range").agg(F.count("*").alias("n"), F.min("number").alias("least"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each task of the sort, whose numbers are consecutive
    offsets = held.select(F.col("range").alias("of"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least") + 1).alias("offset"))
    ranked = ordered.join(F.broadcast(offsets), F.col("range") == F.col("of"))
    return ranked.withColumn("rank", F.col("number") + F.col("offset")).drop("range", "number", "of", "offset"), at


@operator
def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", longest: int = 3, least_words: int = 20, percent: int = 5, seed: int = 42
) -> DataFrame:
    """Per row: id, n_features, weight, score and rank, null for documents that are not drawn. Of the documents with at
    least ``least_words`` words, ``percent`` in a hundred are."""
    scored = weights(docs, target, id_col=id_col, text_col=text_col, target_text_col=target_text_col, longest=longest)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = scored.withColumn("score", F.col("weight") + noise).withColumn("enough", F.col("n_words") >= least_words)
    drawn = percent * scored.filter("enough").count() // 100
    ranked, at = numbered(scored, [F.desc("enough"), F.desc("score"), F.asc_nulls_last("id")])
    out = cut(ranked.select("id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")))
    drop_stored(docs.sparkSession, at)
    return out.withColumnRenamed("id", id_col)
