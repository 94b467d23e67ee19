"""Exact BM25 top-k search: an inverted index per shard, block-max WAND, and an exact merge.

Shards are runs of rows as the input's partitions hold them, so no text is shuffled. In a shard the documents are put
in an order that brings similar ones together (repeated halving along the main direction of their common terms), and
a term's postings (place, count) follow it. ``BLOCK`` neighbouring places are a block; the maxima of a term's impacts
in blocks are the block-max entries. All shards score with the same global statistics (documents, mean length,
document frequencies of the terms asked for), so the best k of the shards' best k are the best k of all.

A few hundred queries walk a shard side by side. Each has a bound for every block, the sum of its terms' weights times
their block maxima, and a threshold: the k-th best score that it has seen in any shard of the task so far. A query's
pivot is the next block in order whose bound reaches its threshold; all its cursors move there, past the postings
of the blocks between, which are never read. The block is scored for those queries whose pivot it is, and their
thresholds rise at once. The block of the largest bound is scored first, so thresholds are tight from the start.
Scores are rounded to 9 decimals, so that equal documents tie.

Shards are dealt to groups of ``group_shards``, at least ``groups`` of them, each read by one task, which gives k rows a
query: tasks grow with the index, and so do the rows of the map, queries * k * groups. They are merged in two levels,
first the best k of about the square root of the groups, then of all, so no task gets the rows of all groups for a query.
Queries are taken in hashed blocks of about
``queries_at_once`` queries or ``terms_at_once`` terms, whichever gives more blocks; the terms of one block are
broadcast, which bounds the driver, and a block's queries are dealt in slices over further tasks. Each block is a
pass over the index.

Null and empty texts match nothing and, as queries, find nothing. Equal scores are ordered by id. A row may find
itself. Repeated rows are documents each. Rows with a null id are searched, but are no queries. Of several queries
with one id the one with the smallest hash of its terms is taken.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, drop_stored, map_texts, operator, store

BLOCK = 64
_NULL = -(1 << 63)
_TERM = re.compile(r"\w+")
_INDEX = "n int, total bigint, ids array<bigint>, lengths array<int>, terms array<bigint>, starts array<int>, place array<int>, count array<int>"
# packed, arrays are bytes, which pass from Parquet through the JVM to a task as they are; numbers of postings take as few as they need
_KINDS = {"ids": np.int64, "lengths": np.int32, "terms": np.int64, "starts": np.int32, "place": None, "count": None}
_PACKED = f"n int, total bigint, {', '.join(f'{c} binary' for c in _KINDS)}"


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall(text.lower()) if text else []


def _packed(c: str, x: np.ndarray) -> bytes:
    """An array of the index as bytes; those of postings begin with the bytes that a number has."""
    if _KINDS[c]:
        return x.astype(_KINDS[c]).tobytes()
    width = next(w for w in (1, 2, 4) if not len(x) or x.max() < 1 << (8 * w - (w == 4)))
    return bytes((width,)) + x.astype(f"<u{width}").tobytes()


def _unpacked(c: str, x: bytes) -> np.ndarray:
    return np.frombuffer(x, _KINDS[c]) if _KINDS[c] else np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int32)


def _hashes(terms) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in terms), np.uint64).view(np.int64)


def similar_order(x: np.ndarray, leaf: int = BLOCK, steps: int = 5) -> np.ndarray:
    """The rows of a matrix in an order of similar neighbours: halved along the main direction down to ``leaf`` rows."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        y = x[rows] - x[rows].mean(0)
        v = y[np.argmax((y * y).sum(1))]
        for _ in range(steps):
            v = (y @ v) @ y
            v = v / (np.sqrt(v @ v) + 1e-12)
        order = np.argsort(y @ v, kind="stable")
        half = max(1, -(-len(rows) // leaf) // 2) * leaf
        todo += [rows[order[half:]], rows[order[:half]]]
    return np.concatenate(out) if out else np.arange(0)


def _ordered(lengths: np.ndarray, term: np.ndarray, place: np.ndarray, count: np.ndarray, common: int = 128) -> np.ndarray:
    """The new place of each document of a shard, by the impacts of its most common terms."""
    unique, at, seen = np.unique(term, return_inverse=True, return_counts=True)
    often = np.argsort(-seen, kind="stable")[:common]
    column = np.full(len(unique), -1)
    column[often] = np.arange(len(often))
    held = column[at] >= 0
    norm = 0.3 + 0.9 * lengths / max(lengths.mean(), 1e-9)
    x = np.zeros((len(lengths), len(often)), np.float32)
    x[place[held], column[at[held]]] = (count / (count + norm[place]) * np.log1p(len(lengths) / seen[at]))[held]
    new = np.empty(len(lengths), np.int32)
    new[similar_order(x)] = np.arange(len(lengths), dtype=np.int32)
    return new


def build_index(rows: DataFrame, shard_rows: int, shard_chars: int, packed: bool = False) -> DataFrame:
    """One row a shard of (id, text) rows; terms ascend by hash, and starts has one entry more than terms. ``packed`` gives
    the arrays as bytes."""
    schema = _PACKED if packed else _INDEX
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, hashes, counts, chars = [], [], [], [], 0
        known: dict[str, int] = {}

        def done():
            term = np.concatenate(hashes)
            place = np.repeat(np.arange(len(ids), dtype=np.int32), [len(h) for h in hashes])
            count, size = np.concatenate(counts), np.array(lengths, np.int32)
            new = _ordered(size, term, place, count)
            old = np.argsort(new)
            place = new[place]
            order = np.lexsort((place, term))
            unique, first = np.unique(term[order], return_index=True)
            arrays = (np.array(ids)[old], size[old], unique, np.append(first, len(term)), place[order], count[order])
            columns = (len(ids), int(size.sum()), *(map(_packed, _KINDS, arrays) if packed else arrays))
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = Counter(terms_of(text))
                    new = [t for t in found if t not in known]
                    if len(known) + len(new) > 400_000:
                        known.clear()
                        new = list(found)
                    known.update(zip(new, _hashes(new).tolist(), strict=True))
                    ids.append(i)
                    lengths.append(found.total())
                    hashes.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
                    counts.append(np.fromiter(found.values(), np.int32, len(found)))
                    chars += len(text or "")
                    if len(ids) >= shard_rows or chars >= shard_chars:
                        yield done()
                        ids, lengths, hashes, counts, chars = [], [], [], [], 0
        if ids:
            yield done()

    return rows.mapInArrow(run, schema)


def frequencies(index: DataFrame, rows_at_once: int = 65_536) -> DataFrame:
    """term, df: in how many documents of each shard a term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                terms, starts = (_unpacked(c, batch.column(c)[row].as_py()) for c in ("terms", "starts"))
                df = np.diff(starts)
                for at in range(0, len(terms), rows_at_once):
                    yield pa.RecordBatch.from_arrays([pa.array(terms[at : at + rows_at_once], pa.int64()), pa.array(df[at : at + rows_at_once], pa.int32())], names=["term", "df"])

    return index.select("terms", "starts").mapInArrow(run, "term bigint, df int")


def _spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all spans, one after the other, and the span of each."""
    n = end - start
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[owner], owner


class Shard:
    """A shard's postings with their impacts under the global mean length, and their block maxima.

    Terms in many of its documents also have a dense row of impacts; the others are read by their postings.
    ``common`` is the share of documents from which a term is dense, ``most_common`` the number of dense rows at most
    (the most frequent terms), so the shard's memory is bounded.
    """

    def __init__(self, ids, lengths, terms, starts, place, count, mean_length: float, k1: float, b: float, common: float = 1 / 24, most_common: int = 768) -> None:
        self.ids, self.terms, self.place = ids, terms, place
        norm = k1 * (1 - b + b * lengths / max(mean_length, 1e-9))
        self.impact = count * (k1 + 1) / (count + norm[place]) if len(place) else np.empty(0)
        self.blocks = -(-len(ids) // BLOCK)
        df = np.diff(starts)
        often = np.argsort(-df, kind="stable")[:most_common]
        often = np.sort(often[df[often] > common * len(ids)])
        self.row = np.full(len(terms), -1)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.blocks * BLOCK))
        at, owner = _spans(starts[often], starts[often + 1])
        self.dense[owner, place[at]] = self.impact[at]
        self.dense_max = self.dense.reshape(len(often), self.blocks, BLOCK).max(2) if len(often) else np.zeros((0, self.blocks))
        # block-max entries: a term's postings in one block
        block = place // BLOCK
        new = np.ones(len(place), bool)
        new[1:] = block[1:] != block[:-1]
        new[starts[:-1]] = True
        self.first = np.append(np.flatnonzero(new), len(place))  # an entry's first posting
        self.block = block[self.first[:-1]]
        self.block_max = np.maximum.reduceat(self.impact, self.first[:-1]) if len(place) else np.empty(0)
        self.entry = np.searchsorted(self.first, starts)  # a term's first entry


class Walk:
    """Queries that walk over shards with their best k so far: scores, ids and thresholds."""

    def __init__(self, sizes: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int) -> None:
        """``term`` and ``weight`` hold the terms of all queries one after the other, ``sizes`` their numbers."""
        self.q, self.k = len(sizes), k
        self.owner, self.weight = np.repeat(np.arange(self.q), sizes), weight
        self.term, self.of = np.unique(term, return_inverse=True)
        self.score = np.zeros((self.q, k))
        self.id = np.full((self.q, k), np.iinfo(np.int64).max)
        self.met = self.scored = 0  # blocks of queries; those not scored were skipped

    def over(self, shard: Shard) -> None:
        if not self.q or not len(shard.terms):
            return
        at = np.minimum(np.searchsorted(shard.terms, self.term), len(shard.terms) - 1)
        here = shard.terms[at] == self.term
        held = here[self.of]
        owner, at, weight = self.owner[held], at[self.of[held]], self.weight[held]
        row = shard.row[at]
        dense = row >= 0
        heavy = np.zeros((self.q, len(shard.dense)))
        heavy[owner[dense], row[dense]] = weight[dense]
        entry, of = _spans(shard.entry[at[~dense]], shard.entry[at[~dense] + 1])
        owner, weight, block = owner[~dense][of], weight[~dense][of], shard.block[entry]
        bound = np.bincount(owner * shard.blocks + block, weight * shard.block_max[entry], self.q * shard.blocks).reshape(self.q, shard.blocks)
        bound = (bound + heavy @ shard.dense_max) * (1 + 1e-9)
        order = np.argsort(block.astype(np.uint16) if shard.blocks < 1 << 16 else block, kind="stable")
        entry, owner, weight = entry[order], owner[order], weight[order]
        first = np.searchsorted(block[order], np.arange(shard.blocks + 1))  # a block's entries of all queries
        number = np.full(self.q, -1)

        def visit(b: int, who: np.ndarray) -> None:
            width = min(BLOCK, len(shard.ids) - b * BLOCK)
            number[who] = np.arange(len(who))
            mine = slice(first[b], first[b + 1])
            in_who = number[owner[mine]] >= 0
            e = entry[mine][in_who]
            post, which = _spans(shard.first[e], shard.first[e + 1])
            cell = number[owner[mine][in_who]][which] * BLOCK + shard.place[post] - b * BLOCK
            number[who] = -1
            score = np.bincount(cell, weight[mine][in_who][which] * shard.impact[post], len(who) * BLOCK).reshape(len(who), BLOCK)
            score = (score + heavy[who] @ shard.dense[:, b * BLOCK : (b + 1) * BLOCK])[:, :width].round(9)
            better = (score > 0) & (score >= self.score[who, -1:])
            some = np.flatnonzero(better.any(1))
            if len(some):
                who = who[some]
                s = np.concatenate([self.score[who], np.where(better[some], score[some], 0)], 1)
                i = np.concatenate([self.id[who], np.broadcast_to(shard.ids[b * BLOCK : b * BLOCK + width], (len(who), width))], 1)
                best = np.lexsort((i, -s), axis=1)[:, : self.k]
                self.score[who], self.id[who] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)

        best = bound.argmax(1)
        for b in np.unique(best):
            who = np.flatnonzero((best == b) & (bound[:, b] > 0) & (bound[:, b] + 1e-9 >= self.score[:, -1]))
            if len(who):
                visit(b, who)
                self.scored += len(who)
        bound[np.arange(self.q), best] = 0
        for b in range(shard.blocks):
            who = np.flatnonzero((bound[:, b] > 0) & (bound[:, b] + 1e-9 >= self.score[:, -1]))
            if len(who):
                visit(b, who)
                self.scored += len(who)
        self.met += self.q * shard.blocks

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, id and score of all that was found."""
        q, r = np.nonzero(self.score > 0)
        return q, self.id[q, r], self.score[q, r]


@operator
def search(
    docs: DataFrame, queries: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 10, k1: float = 1.2, b: float = 0.75, shard_rows: int = 4096, shard_chars: int = 16_000_000, queries_at_once: int = 32_000, terms_at_once: int = 4_000_000, groups: int = 12, group_shards: int = 8, side_by_side: int = 256, slice_queries: int = 2048
) -> DataFrame:
    """The k best documents of each query (id, text; each distinct term counts once): query_id, rank, the found id, score."""
    spark = docs.sparkSession
    number = F.col(f"`{id_col}`").cast("bigint")
    # rows of megabytes: a row group's size is looked at after each, not first after a hundred, and a reader holds one whole
    written = {"parquet.block.size": str(16 << 20), "parquet.enable.dictionary": "false", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.page.size.row.check.min": "1"}
    index, index_at = store(build_index(docs.select(F.coalesce(number, F.lit(_NULL)).alias("id"), F.col(f"`{text_col}`").alias("text")), shard_rows, shard_chars, packed=True), **written)
    n, total, shards_there = index.agg(F.sum("n"), F.sum("total"), F.count("*")).first()
    n, total = n or 0, total or 0
    groups = max(groups, -(-shards_there // group_shards))
    first_level = math.isqrt(groups) if groups > 12 else 1

    def make():
        return lambda x: {"id": x["id"], "terms": [np.unique(_hashes(set(terms_of(t)))) for t in x["text"]]}

    asked = queries.select(number.alias("id"), F.col(f"`{text_col}`").alias("text")).filter(F.col("id").isNotNull())
    asked, asked_at = store(map_texts(asked, ["id", "text"], make, "id bigint, terms array<bigint>"))
    # document frequencies of the terms that are asked for
    wanted = asked.select(F.explode("terms").alias("term")).distinct()
    frequency, frequency_at = store(frequencies(index).groupBy("term").agg(F.sum("df").alias("df")).join(wanted, "term", "left_semi"))
    rows, terms = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-rows // queries_at_once), -(-terms // terms_at_once))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    mean, out = total / max(1, n), None
    for block in range(blocks):
        mine = asked.filter(F.col("block") == block).groupBy("id").agg(F.min_by("terms", F.xxhash64("terms")).alias("terms"))
        held = mine.toArrow().combine_chunks()
        known = frequency.join(mine.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi").toArrow()
        term, df = known.column("term").to_numpy(), known.column("df").to_numpy()
        order = np.argsort(term)
        term, df = term[order], df[order]
        lists = held.column("terms").combine_chunks() if held.num_rows else pa.array([], pa.list_(pa.int64()))
        sizes, flat = np.diff(lists.offsets.to_numpy()), lists.values.to_numpy()
        at = np.minimum(np.searchsorted(term, flat), max(0, len(term) - 1))
        found = term[at] == flat if len(term) else np.zeros(len(flat), bool)
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[found], minlength=len(sizes))
        weight = np.log(1 + (n - df + 0.5) / (df + 0.5))[at[found]] if len(term) else np.empty(0)
        told = spark.sparkContext.broadcast((held.column("id").to_numpy(), sizes, flat[found], weight))
        slices = max(1, -(-held.num_rows // slice_queries))
        best = None
        for part in range(slices):

            def run(batches: Iterator[pa.RecordBatch], told=told, part=part, slices=slices) -> Iterator[pa.RecordBatch]:
                ids, sizes, term, weight = told.value
                ends = np.append(0, np.cumsum(sizes))
                low, high = len(ids) * part // slices, len(ids) * (part + 1) // slices
                walks = [(at, to, Walk(sizes[at:to], term[ends[at] : ends[to]], weight[ends[at] : ends[to]], k)) for at in range(low, high, side_by_side) for to in [min(high, at + side_by_side)]]
                for batch in batches:
                    for at in range(batch.num_rows):
                        shard = Shard(*(_unpacked(c, batch.column(c)[at].as_py()) for c in _KINDS), mean, k1, b)
                        for _, _, walk in walks:
                            walk.over(shard)
                for at, to, walk in walks:
                    q, i, s = walk.best()
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at:to][q], pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "found", "score"])

            shards = index.select(*_KINDS).coalesce(groups)
            some = shards.mapInArrow(run, "query_id bigint, found bigint, score double")
            best = some if best is None else best.unionByName(some)
        if first_level > 1:  # documents are in one part each, so the best k of the parts' best are those of all
            part = F.row_number().over(Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "found"))
            best = best.withColumn("part", F.pmod(F.xxhash64("found"), F.lit(first_level))).withColumn("rank", part).filter(F.col("rank") <= k).drop("part", "rank")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "found"))
        top = cut(best.withColumn("rank", rank).filter(F.col("rank") <= k))
        out = top if out is None else out.unionByName(top)
        told.unpersist()
    for path in (index_at, asked_at, frequency_at):
        drop_stored(spark, path)
    return out.select("query_id", "rank", F.when(F.col("found") > _NULL, F.col("found")).alias(id_col), "score")
