"""Document fingerprints by consistent weighted sampling.

The weighted terms of a text are its 2-word shingles (single words where there are fewer) with their counts. For
each of ``samples`` samples a term x of weight S draws r ~ Gamma(2,1), c ~ Gamma(2,1) and b ~ U(0,1), fixed by x and
the sample alone; with t = floor(ln S / r + b) the term with the smallest ln c - r (t - b) - r is taken. The pair
(term, t) agrees between two texts with their generalised Jaccard similarity sum min / sum max as probability, so
the share of equal samples estimates it. A sample is kept as 15 bits of a hash, above a bit that tells it from none.

Draws come from one pool of 65,536 triples; each sample reads the place that its own multiplicative hash of the
term gives, and equal values are decided by the term's hash.

Null texts count as empty. Empty texts have the all-zero fingerprint, alike with each other (1) and with nothing
else (0). Equal texts have equal fingerprints. Very long texts are sampled whole, 512 terms at a time. Rows of one id
stand in the order of their texts' hashes; the only row of a table is its own next one. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import partitions

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Sampler:
    """Fingerprints of texts."""

    def __init__(self, samples: int = 64, seed: int = 23) -> None:
        rng = np.random.default_rng(seed)
        n = 1 << 16
        self.samples = samples
        self.r = rng.gamma(2.0, 1.0, n).astype(np.float32)
        self.b = rng.random(n, np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, n)).astype(np.float32)
        self.one = self.log_c + self.r * self.b - self.r  # for weight 1: t is 0
        self.mult = rng.integers(0, 1 << 63, samples, np.uint64) * np.uint64(2) + np.uint64(1)

    def terms(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        if len(h) > 1:
            h = (h[:-1] * _MIX + h[1:]) * _MIX
            h ^= h >> np.uint64(32)
        return np.unique(h, return_counts=True)

    def sample(self, text: str | None) -> np.ndarray:
        """An odd 16-bit code for each sample; zeros for a text without words."""
        term, weight = self.terms(text or "")
        if not len(term):
            return np.zeros(self.samples, np.uint16)
        best = np.full(self.samples, np.inf, np.float32)
        of, level = np.zeros(self.samples, np.uint64), np.zeros(self.samples, np.int64)
        single = weight == 1
        for ones in (True, False):
            group = term[single] if ones else term[~single]
            log_s = None if ones else np.log(weight[~single]).astype(np.float32)
            for at in range(0, len(group), 512):
                x = group[at : at + 512]
                place = ((x[:, None] * self.mult) >> np.uint64(48)).astype(np.int64)
                if ones:
                    a, t = self.one[place], None
                else:
                    r, b = self.r[place], self.b[place]
                    t = np.floor(log_s[at : at + 512, None] / r + b)
                    a = self.log_c[place] - r * (t - b) - r
                k = a.argmin(0)  # terms ascend, so the first of equal values is the smallest term
                low = a[k, np.arange(self.samples)]
                win = (low < best) | ((low == best) & (x[k] < of))
                best[win], of[win] = low[win], x[k][win]
                level[win] = 0 if t is None else t[k, np.arange(self.samples)][win].astype(np.int64)
        code = (of * _MIX + level.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) + np.arange(self.samples, dtype=np.uint64)
        code ^= code >> np.uint64(32)
        return ((code * _MIX) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples: the estimate of the generalised Jaccard similarity."""
    return float((a == b).mean())


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = 64) -> DataFrame:
    """Per row: id and fingerprint (4 hexadecimal digits a sample). A narrow map."""
    from .common import map_texts

    def make():
        s = Sampler(samples)
        return lambda x: {"id": x[id_col], "fingerprint": [s.sample(t).astype(">u2").tobytes().hex() for t in x[text_col]]}

    kind = dict(docs.dtypes)[id_col]
    return map_texts(docs, [id_col, text_col], make, f"id {kind}, fingerprint string").select(F.col("id").alias(id_col), "fingerprint")


def edited_text(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first characters of the following one, or all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


class Ranges:
    """Consecutive ranges of places with their heads, the smallest (place, hash) of each."""

    def __init__(self, bounds: list[int], heads: list[tuple[int, int]]) -> None:
        self.bounds, self.heads = bounds, heads

    def part(self, place: Column) -> Column:
        """The number of bounds at or below a place, by halving; in the JVM, so texts beside it go nowhere."""
        bounds = F.lit(self.bounds).cast("array<bigint>")
        steps = F.lit([1 << k for k in reversed(range(len(self.bounds).bit_length()))]).cast("array<int>")
        return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(bounds, at + step - 1) <= place, step).otherwise(0))

    def ahead(self, part: Column, place: Column, h: Column) -> Column:
        """For the head of a range the range before (the last for the first), null for other rows."""
        places, hashes = (F.lit([x[k] for x in self.heads]).cast("array<bigint>") for k in range(2))
        return F.when((F.get(places, part) == place) & (F.get(hashes, part) == h), F.pmod(part - 1, F.lit(max(1, len(self.heads)))))


def byte_ranges(rows: DataFrame, most: int, finer: int = 8) -> Ranges:
    """At most ``most`` ranges with about equal bytes of text, from (place, h, text).

    A quantile sketch cuts the places into ``finer`` times as many ranges of equal rows; neighbours are joined by their
    bytes. One row of each goes to the driver.
    """
    n = most * finer
    cuts = sorted(set(rows.agg(F.percentile_approx("place", [k / n for k in range(1, n)] or [0.5], 10 * n)).first()[0] or []))
    held = rows.groupBy(Ranges(cuts, []).part(F.col("place")).alias("part")).agg(F.sum(F.octet_length("text") + 64).alias("bytes"), F.min(F.struct("place", "h")).alias("head"))
    got = sorted((r["part"], r["bytes"], (r["head"]["place"], r["head"]["h"])) for r in held.collect())
    total, before, last, bounds, heads = sum(r[1] for r in got), 0, -1, [], []
    for part, size, head in got:
        number = int((before + size / 2) / total * most)
        if number != last:
            if heads:
                bounds.append(cuts[part - 1])
            heads.append(head)
        before, last = before + size, number
    return Ranges(bounds, heads)


def fingerprint_in_order(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = 64) -> DataFrame:
    """Per row: id, n_chars, the fingerprint of its text and of its edited text, and the likeness to the latter and
    to the next row in the order of (id, hash of the text); after the last comes the first. Null ids come first.

    Texts are shuffled once, into ranges of ids with about equal bytes, one range a task. Each range is read in order,
    so a row meets the next one; the first row of each range is read once more at the end of the range before. Rows of
    one id stand in one range.
    """
    spark = docs.sparkSession
    tasks = partitions(spark)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.coalesce(F.col("id").cast("bigint"), F.lit(-(1 << 63)))).withColumn("h", F.xxhash64("text"))
    ranges = byte_ranges(rows, tasks)
    rows = rows.withColumn("part", ranges.part(F.col("place")))
    rows = rows.withColumn("ahead", ranges.ahead(F.col("part"), F.col("place"), F.col("h")))
    spot = F.struct(F.lit(0).alias("late"), F.col("part").alias("part"))
    spots = F.when(F.col("ahead").isNull(), F.array(spot)).otherwise(F.array(spot, F.struct(F.lit(1).alias("late"), F.col("ahead").alias("part"))))
    dealt = rows.withColumn("spot", F.explode(spots)).select("id", "text", "place", "h", F.col("spot.late").alias("late"), F.col("spot.part").alias("part"))
    ranged_rows = dealt.repartitionById(tasks, "part").sortWithinPartitions("part", "late", "place", "h")
    schema = T._parse_datatype_string(f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sampler(samples)
        out: list[tuple] = []
        held = None  # the row that waits for the next one

        def finish(row, following, code):
            i, text, _, own = row
            changed = edited_text(text, following)
            other = own if changed == text else s.sample(changed)
            digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((i, len(text), digest, own.astype(">u2").tobytes().hex(), other.astype(">u2").tobytes().hex(), likeness(own, other), likeness(own, code)))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                for i, text, late, p in zip(*(b.column(k).to_pylist() for k in (0, 1, 4, 5)), strict=True):
                    if late and (held is None or held[2] != p):
                        continue  # a second copy of a head: the range is finished
                    code = s.sample(text)
                    if held is not None:
                        finish(held, text, code)
                    held = None if late else (i, text, p, code)
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                    out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return ranged_rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
