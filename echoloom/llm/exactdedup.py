"""Exact duplicates by Grace hash partitioning and open-addressing tables that compare complete contents.

Contents are texts with A-Z in lower case, as UTF-8. The stages:

1. Each scan task gathers its rows in a table of bounded bytes and writes, when that is full and at its end, one
   record an entry (its content, count and largest id) and one light row a document (id and entry). So copies that
   one task reads are one record before anything is shuffled.
2. Records are partitioned by a hash of their content to spill files, and each partition goes through a table. When it
   is full, it takes no more contents: records of contents that it holds are counted on, any others are written to the
   next level's spill files and partitioned again by another hash, until all buckets fit. Each level settles at
   least one content of each bucket.
3. Light rows meet the result of their entry.

Contents that very many scan tasks hold (more than ``HOT`` records and a 2,000th of all) are first combined in salted
parts, each of about the square root of the records, so no task gets them all. Levels and results are tables in the
shared folder, so lost executors cost the tasks that they ran.

Null texts count as empty and are copies of each other. Of rows with one id and equal texts, which are one document,
each is a row of the group and has the same result. A null id is never the one that stays, unless its group has no
other: then keep_id is null and its rows are kept. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_stored, map_stream, operator, partitions, store

HOT = 64
_RECORD = "entry bigint, h bigint, n bigint, top bigint, content binary"


def normalised(text: bytes | None) -> bytes:
    """Text in UTF-8 with A-Z, and no other letters, in lower case."""
    return (text or b"").lower()


class ContentTable:
    """An open-addressing table of complete contents with linear probing, closed for new ones beyond ``most_bytes``.

    A slot holds the number of an entry; an entry is found only where its whole content is equal.
    """

    def __init__(self, most_bytes: int) -> None:
        self.most, self.bytes, self.closed = most_bytes, 0, False
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.slots = [-1] * 1024

    def __len__(self) -> int:
        return len(self.contents)

    def _probe(self, h: int, content: bytes) -> tuple[int, int]:
        """The slot where the content is or would be, and its entry or -1."""
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                return at, k
            at = (at + 1) & mask
        return at, -1

    def put(self, h: int, content: bytes) -> int:
        """The entry of a content, new or not; -1 if it is new and the table is closed."""
        at, k = self._probe(h, content)
        if k >= 0 or self.closed:
            return k
        if self.contents and self.bytes + len(content) > self.most:
            self.closed = True
            return -1
        self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 64
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return len(self.contents) - 1

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for k, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def _larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def _binary(batch: pa.RecordBatch, k: int) -> list[bytes | None]:
    return batch.column(k).cast(pa.large_binary()).to_pylist()


def _parts(sizes: list[int], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive contents of at most ``most`` bytes, or one content."""
    low = total = 0
    for k, n in enumerate(sizes):
        if k > low and total + n > most:
            yield low, k
            low, total = k, 0
        total += n + 64
    if low < len(sizes):
        yield low, len(sizes)


def gather(docs: DataFrame, id_col: str, text_col: str, table_bytes: int) -> DataFrame:
    """Per scan task and content a record (entry, h, n, top, size, content), and per document a light row (entry, id)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        base, given = TaskContext.get().partitionId() << 36, 0
        table = ContentTable(table_bytes)
        count, top, light = [], [], ([], [])

        def full() -> Iterator[dict]:
            nonlocal table, given
            for a, b in _parts([len(c) for c in table.contents]):
                m = b - a
                hashes = [h - (1 << 64) if h >> 63 else h for h in table.hashes[a:b]]
                yield {"entry": [base + given + k for k in range(a, b)], "id": [None] * m, "h": hashes, "n": count[a:b], "top": top[a:b], "size": [len(c) for c in table.contents[a:b]], "content": table.contents[a:b]}
            m = len(light[0])
            yield {"entry": light[0][:], "id": light[1][:]} | {c: [None] * m for c in ("h", "n", "top", "size", "content")}
            given += len(table)
            table = ContentTable(table_bytes)
            for x in (count, top, *light):
                x.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, text in zip(part.column(0).to_pylist(), _binary(part, 1), strict=True):
                    content = normalised(text)
                    h = xxhash.xxh3_64_intdigest(content)
                    k = table.put(h, content)
                    if k < 0:
                        yield from full()
                        k = table.put(h, content)
                    if k == len(count):
                        count.append(0)
                        top.append(None)
                    count[k] += 1
                    top[k] = _larger(top[k], i)
                    light[0].append(base + given + k)
                    light[1].append(i)
                if len(light[0]) >= 1 << 18:
                    yield from full()
        yield from full()

    return map_stream(rows, ["id", "text"], run, "entry bigint, id bigint, h bigint, n bigint, top bigint, size int, content binary")


def _through_tables(records: DataFrame, table_bytes: int, combine: bool) -> DataFrame:
    """Each partition's records through a table: settled ones as (entry, rep, n, top, sha), those that wait for the next
    level with their content. With ``combine`` the first record of a content stands for the others of its partition, as a
    record that waits, and the rest are settled with their ``rep`` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table = ContentTable(table_bytes)
        rep, count, top, met = [], [], [], ([], [])

        def waiting(rows: list[tuple]) -> dict:
            entry, h, n, high, content = zip(*rows, strict=True)
            return {"entry": entry, "h": h, "n": n, "top": high, "content": content, "rep": [None] * len(rows), "sha": [None] * len(rows)}

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, late = batch.slice(at, 256), []
                for row in zip(*(part.column(k).to_pylist() for k in range(5)), strict=True):
                    entry, h, n, high, content = row
                    k = table.put(h & ((1 << 64) - 1), content)
                    if k < 0:
                        late.append(row)
                        continue
                    if k == len(rep):
                        rep.append(entry)
                        count.append(0)
                        top.append(None)
                    count[k] += n
                    top[k] = _larger(top[k], high)
                    met[0].append(entry)
                    met[1].append(k)
                if late:
                    yield waiting(late)
        if combine:
            for a, b in _parts([len(c) for c in table.contents]):
                yield waiting([(rep[k], table.hashes[k] - (1 << 64) if table.hashes[k] >> 63 else table.hashes[k], count[k], top[k], table.contents[k]) for k in range(a, b)])
            met = tuple(zip(*((e, k) for e, k in zip(*met, strict=True) if e != rep[k]), strict=True)) or ([], [])
        sha = [None] * len(rep) if combine else [hashlib.sha256(c).hexdigest() for c in table.contents]
        for at in range(0, len(met[0]), 1 << 14):
            entry, of = met[0][at : at + (1 << 14)], met[1][at : at + (1 << 14)]
            nothing = [None] * len(of)
            yield {"entry": entry, "h": nothing, "content": nothing, "rep": [rep[k] for k in of], "n": [count[k] for k in of], "top": [top[k] for k in of], "sha": [sha[k] for k in of]}

    return map_stream(records, ["entry", "h", "n", "top", "content"], run, f"{_RECORD}, rep bigint, sha string")


@operator
def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = 48 << 20, bucket_bytes: int = 16 << 20, hot: int = HOT) -> DataFrame:
    """Per row: id, keep_id (the largest id with an equal text), group_size, kept and text_sha256 (of the content)."""
    spark = docs.sparkSession
    gathered, gathered_at = store(gather(docs, id_col, text_col, table_bytes), compression="zstd")
    spilled = [gathered_at]
    heavy = F.col("size").isNotNull()
    records = gathered.filter(heavy).select("entry", "h", "n", "top", "content")
    total, size = gathered.filter(heavy).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()

    # contents of very many records, less than 2,000 of them
    many = cut(gathered.filter(heavy).groupBy(F.col("h").alias("of_h")).agg(F.count("*").alias("m")).filter(F.col("m") > max(hot, total // 2000)))
    alias = None
    if many.limit(1).count():
        told = F.broadcast(many)
        parts = records.join(told, F.col("h") == F.col("of_h")).withColumn("part", F.pmod(F.xxhash64("entry"), F.ceil(F.sqrt("m")))).repartition(partitions(spark), "h", "part")
        combined, at = store(_through_tables(parts, table_bytes, combine=True), compression="zstd")
        spilled.append(at)
        alias = combined.filter(F.col("content").isNull()).select("entry", "rep")
        records = records.join(told, F.col("h") == F.col("of_h"), "left_anti").unionByName(combined.filter(F.col("content").isNotNull()).select(records.columns))

    settled, level = None, 0
    while True:
        buckets = max(partitions(spark), -(-size // bucket_bytes))
        done, at = store(_through_tables(records.repartition(buckets, F.xxhash64("h", F.lit(level))), table_bytes, combine=False), compression="zstd")
        spilled.append(at)
        got = done.filter(F.col("content").isNull()).select("entry", "n", "top", "sha")
        settled = got if settled is None else settled.unionByName(got)
        records = done.filter(F.col("content").isNotNull()).select("entry", "h", "n", "top", "content")
        left, size = records.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()
        if not left:
            break
        level += 1

    light = gathered.filter(~heavy).select("id", F.col("entry").alias("of"))
    if alias is not None:
        others = alias.select(F.col("entry").alias("of"), "rep").join(settled, F.col("rep") == F.col("entry")).select(F.col("of").alias("entry"), "n", "top", "sha")
        settled = settled.unionByName(others)
    out = cut(light.join(settled, F.col("of") == F.col("entry")).select("id", "top", "n", "sha"))
    for at in spilled:
        drop_stored(spark, at)
    kept = F.coalesce(F.col("id") == F.col("top"), F.col("top").isNull())
    return out.select(F.col("id").alias(id_col), F.col("top").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


@operator
def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of documents that stay, with all their columns; of rows with one id and equal texts, one."""
    found = exact_duplicates(docs, id_col=id_col, text_col=text_col, **options).filter("kept")
    own = "__copy"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    found = found.select(F.col(id_col).alias(f"{own}_id"), F.col("text_sha256").alias(f"{own}_sha")).distinct()
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    content = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), upper, upper.lower())
    keyed = docs.withColumn(f"{own}_of", F.col(f"`{id_col}`").cast("bigint")).withColumn(f"{own}_content", F.sha2(content, 256))
    left = keyed.join(found, F.col(f"{own}_of").eqNullSafe(F.col(f"{own}_id")) & (F.col(f"{own}_content") == F.col(f"{own}_sha")), "left_semi")
    return left.dropDuplicates([f"{own}_of", f"{own}_content"]).drop(f"{own}_of", f"{own}_content")
