"""How the sources of a language differ in their words, by integer-dictionary encoding.

Terms are runs of ASCII letters and characters above ASCII, with A-Z in lower case. A language keeps its terms in at
least ``least_docs`` of its rows. Every (lang, source) group and every language gives each kept term the smoothed share
p = 1 + floor(1000000000 * (count + 2) / (N + 2 * V)), exactly; two shares differ by floor((p - q) ** 2 / (p + q)).

The stages:

1. Scan tasks count terms and documents per group in bounded tables; sums over all tasks, dealt by (lang, term), decide
   what is kept.
2. Kept terms are dealt by ranges of (lang, term), so a chunk holds consecutive terms. In a chunk the sorted array
   of its terms is the dictionary: terms become ids by searchsorted, and a bincount per group makes the dense vectors of
   all groups, also those with no such term. Ids keep the order of UTF-8, so ties in a chunk go by id.
3. A chunk gives the sums of differences of its groups, and the first ``terms`` terms of each group; sums and ranks
   over all chunks are the result. A chunk holds about ``chunk_rows`` counts, or as many as there are pairs of groups
   in the largest language, so the sums that chunks give are no more than the counts.

Null texts, langs and sources count as empty. A group without terms has its smallest shares; a language without kept
terms has pairs with the value 0 and no terms. Repeated rows count each. An empty table gives an empty result. Shares
are exact up to 9 * 10**15 occurrences in a language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_stored, map_stream, operator, partitions, store

_LETTERS = bytes(x | 0x20 if 0x41 <= x <= 0x5A else x if x >= 0x80 or 0x61 <= x <= 0x7A else 0x20 for x in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in order."""
    return text.translate(_LETTERS).split() if text else []


def counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str, most_entries: int = 400_000) -> DataFrame:
    """Parts of counts: lang, source, term, n (occurrences) and docs (rows with the term), of bounded memory a task."""
    given = ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in given))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        found: dict[tuple, tuple[Counter, Counter]] = {}

        def full() -> Iterator[dict]:
            for (lang, source), (n, rows) in found.items():
                names = list(n)
                for at in range(0, len(names), 20_000):
                    part = names[at : at + 20_000]
                    yield {"lang": [lang] * len(part), "source": [source] * len(part), "term": [t.decode("utf-8", "replace") for t in part], "n": [n[t] for t in part], "docs": [rows[t] for t in part]}
            found.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(2).cast(pa.large_binary()).to_pylist()
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
                    n, rows = found.setdefault((lang, source), (Counter(), Counter()))
                    words = terms_of(text)
                    n.update(words)
                    rows.update(set(words))
                if sum(len(n) for n, _ in found.values()) >= most_entries:
                    yield from full()
        yield from full()

    return map_stream(rows, ["lang", "source", "text"], run, "lang string, source string, term string, n bigint, docs bigint")


def shares(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(1000000000 * (count + 2) / (total + 2 * kept)) by long division, so no product leaves 64 bits."""
    of = total + 2 * kept
    rest, p = count + 2, np.zeros(np.broadcast(count, of).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        p = p * 1000 + rest // of
        rest = rest % of
    return 1 + p


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def chunk_rows_of(terms: list[bytes], of: list[str], n: list[int], groups: dict[str, int], lang_total: int, kept: int, most_terms: int, cells: int = 1 << 20) -> Iterator[tuple]:
    """Rows (source, part, item, value) of a chunk: each ordered pair of groups with the sum over its terms, and the
    first terms of each group."""
    names = sorted(groups)
    totals = np.array([groups[x] for x in names], np.int64)[:, None]
    number = {x: k for k, x in enumerate(names)}
    words = np.empty(len(terms), object)
    words[:] = terms
    dictionary = np.unique(words) if len(words) else words
    ids = np.searchsorted(dictionary, words) if len(words) else np.empty(0, np.int64)
    group, n = np.array([number[x] for x in of], np.int64), np.array(n, np.int64)
    sums = np.zeros((len(names), len(names)), np.int64)
    best: list[list[tuple[int, int]]] = [[] for _ in names]
    width = max(1, cells // len(names))
    order = np.argsort(ids, kind="stable")
    ids, group, n = ids[order], group[order], n[order]
    for low in range(0, len(dictionary), width):
        size = min(width, len(dictionary) - low)
        a, b = np.searchsorted(ids, (low, low + size))
        dense = np.zeros((len(names), size), np.int64)
        for k in range(len(names)):
            own = group[a:b] == k
            # weights of a bincount are doubles; counts of a group and term are single rows here, so places are distinct
            dense[k][ids[a:b][own] - low] = n[a:b][own]
        p = shares(dense, totals, kept)
        q = shares(dense.sum(0), np.int64(lang_total), kept)
        for i in range(len(names) - 1):
            s = differences(p[i + 1 :], p[i]).sum(1)
            sums[i, i + 1 :] += s
            sums[i + 1 :, i] += s
        for k in range(len(names)):
            at = np.flatnonzero((dense[k] > 0) & (p[k] > q))
            f = differences(p[k][at], q[at])
            first = np.lexsort((at, -f))[:most_terms]
            best[k] += zip((-f[first]).tolist(), (at[first] + low).tolist(), strict=True)
    for i, x in enumerate(names):
        yield from ((x, "pair", y, int(sums[i, j])) for j, y in enumerate(names) if i != j)
        yield from ((x, "term", dictionary[k].decode("utf-8"), -f) for f, k in sorted(best[i])[:most_terms])


@operator
def source_divergence(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, terms: int = 10, chunk_rows: int = 20_000
) -> DataFrame:
    """Per group: lang, source, part (``pair`` or ``term``), item, value and rank (by value descending, then by item)."""
    spark = docs.sparkSession
    tasks = partitions(spark)
    dealt = counts(docs, text_col, lang_col, source_col).repartition(tasks, "lang", "term")
    counted = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    here = Window.partitionBy("lang", "term")
    first = F.row_number().over(here.orderBy("source")) == 1
    held = counted.withColumn("all_docs", F.sum("docs").over(here)).withColumn("first", first.cast("int")).filter(F.col("all_docs") >= least_docs)
    kept, kept_at = store(held.select("lang", "term", "source", "n", "first"))

    named = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("first"))
    groups = cut(named.distinct().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("first", F.lit(0)).alias("first")))
    langs = cut(groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("first").alias("kept"), F.count("*").alias("groups")))
    rows, most = kept.count(), langs.agg(F.max("groups")).first()[0] or 0
    ranges = max(1, -(-rows // max(chunk_rows, most * most)))
    chunked, chunked_at = store(kept.select("lang", "term", "source", "n").repartitionByRange(ranges, "lang", "term").withColumn("chunk", F.spark_partition_id()))
    # every language has a chunk, also without kept terms
    chunks = langs.join(chunked.select("lang", "chunk").distinct(), "lang", "left").select("lang", "lang_total", "kept", F.coalesce("chunk", F.lit(-1)).alias("chunk"))
    heads = groups.select("lang", "source", "total").join(chunks, "lang")

    def of_chunk(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        of = dict(zip(right["source"].to_pylist(), right["total"].to_pylist(), strict=True))
        found = [t.encode("utf-8") for t in left["term"].to_pylist()]
        out = list(chunk_rows_of(found, left["source"].to_pylist(), left["n"].to_pylist(), of, right["lang_total"][0].as_py(), right["kept"][0].as_py(), terms))
        source, part, item, value = zip(*out, strict=True) if out else ((), (), (), ())
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.table([pa.array(x, t) for x, t in zip(([lang] * len(out), source, part, item, value), kinds, strict=True)], names=["lang", "source", "part", "item", "value"])

    each = chunked.groupBy("lang", "chunk").cogroup(heads.groupBy("lang", "chunk")).applyInArrow(of_chunk, "lang string, source string, part string, item string, value bigint")
    summed = each.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    out = cut(summed.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= terms)))
    for at in (kept_at, chunked_at):
        drop_stored(spark, at)
    return out
