"""Source divergence, importance resampling and exact copies against plain versions and SQL."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from echoloom.llm import divergence, exactdedup, importance, queries
from echoloom.llm.divergence import source_divergence
from echoloom.llm.exactdedup import ContentTable, drop_copies, exact_duplicates
from echoloom.llm.importance import resample

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Divergence -----------------------------------------------------------------------------------------------------------


def plain_divergence(rows, least):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    count, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(UPPER))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {r[1] for r in rows}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = {r[2] for r in rows if r[1] == lang}
        p = {}
        for name, n in [(s, count[lang, s]) for s in sources] + [(None, sum((count[lang, s] for s in sources), Counter()))]:
            total = sum(n[t] for t in kept)
            p[name] = {t: 1 + 10**9 * (n[t] + 2) // (total + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, o) in enumerate(sorted(pairs, key=lambda x: (x[0], x[1].encode())))]
            terms = [(-f(p[s][t], p[None][t]), t) for t in kept if count[lang, s][t] and p[s][t] > p[None][t]]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, t) in enumerate(sorted(terms, key=lambda x: (x[0], x[1].encode()))[:10])]
    return sorted(out, key=repr)


def test_divergence_of_documents(spark, small_dir, monkeypatch):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    want = plain_divergence([(r["text"], r["lang"], r["source"]) for r in docs.collect()], 10)
    assert rows_of(source_divergence(docs)) == want and {r[2] for r in want} == {"pair", "term"}
    assert rows_of(source_divergence(docs.repartition(7), chunk_rows=300)) == want  # in many chunks


def test_divergence_of_ties_odd_rows_and_empty_tables(spark, odd, none):
    for docs, least in ((odd, 1), (odd, 2), (odd, 10)):
        want = plain_divergence([(r["text"], r["lang"], r["source"]) for r in odd.collect()], least)
        assert rows_of(source_divergence(docs, least_docs=least)) == want
        assert rows_of(source_divergence(docs, least_docs=least, chunk_rows=1)) == want
    assert source_divergence(none).count() == 0
    texts = [("b a c é z ﬀ 中 𝔘 Ä ä", "x", s) for s in ("s1", "s2") for _ in range(3)] + [("q Q", "x", "s3"), ("!", "x", "s4"), (None, None, None), ("1 2", "y", "s1")]
    got = source_divergence(spark.createDataFrame(texts, "text string, lang string, source string"), least_docs=1)
    assert rows_of(got) == plain_divergence(texts, 1)


def test_shares_are_exact_where_products_leave_64_bits():
    rng = np.random.default_rng(1)
    for _ in range(200):
        total, kept = int(rng.integers(1, 9 * 10**15)), int(rng.integers(1, 10**6))
        count = rng.integers(0, total + 1, 5)
        want = [1 + 10**9 * (int(c) + 2) // (total + 2 * kept) for c in count]
        assert divergence.shares(count, np.int64(total), kept).tolist() == want
    assert divergence.shares(np.array([7]), np.int64(7), 1).tolist() == [1 + 10**9]


# Importance -----------------------------------------------------------------------------------------------------------


def plain_resample(rows, target, percent=5, least=20):
    """rows: (id, text)."""

    def features(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))
        return len(w), [crc32(" ".join(w[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]

    held = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in held for b in f), Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out = []
    for i, n, f in held:
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = Counter()
    drawn = {}
    for k, r in enumerate(order[: percent * len(order) // 100]):
        drawn.setdefault(r, []).append(k + 1)
    result = []
    for r in out:
        ranks = drawn.get(r, [])
        result.append((r[0], *r[2:], ranks[rank[r]] if rank[r] < len(ranks) else None))
        rank[r] += 1
    return sorted(result, key=repr)


def test_resampling_of_documents(spark, small_dir, monkeypatch):
    docs, target = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    got = queries.op12_importance_resampling(spark, small_dir)
    assert [*map(tuple, got.dtypes)] == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert rows_of(got) == want and sum(r[4] is not None for r in want) > 5
    monkeypatch.setattr(importance, "BLOCK_ROWS", 7)  # many blocks and salts
    monkeypatch.setattr(importance, "GROUP_BYTES", 1000)
    assert rows_of(resample(docs.repartition(6), target)) == want


def test_resampling_of_odd_rows_and_empty_tables(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    target = spark.createDataFrame([("the quick brown fox",), (None,), ("",)], "text string")
    for given, texts in ((target, ["the quick brown fox"]), (target.limit(0), [])):
        assert rows_of(resample(odd, given, percent=50, least_words=3)) == plain_resample(rows, texts, 50, 3)
    assert resample(none, target).count() == 0
    hot = spark.createDataFrame([(k, "one " * 70_000) for k in range(3)], "doc_id long, text string")  # counts beyond 16 bits
    assert rows_of(resample(hot, target, percent=100)) == plain_resample([tuple(r) for r in hot.collect()], ["the quick brown fox"], 100)


# Exact copies ---------------------------------------------------------------------------------------------------------


def plain_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UPPER)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def test_copies_of_documents(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    want = plain_copies([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert rows_of(exact_duplicates(docs)) == want and any(not r[3] for r in want)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [r[0] for r in sorted(want) if r[3]]


def test_buckets_that_do_not_fit_are_partitioned_again(spark):
    """Tables of a few contents: several levels; a third of the rows are one text, in records of many scan tasks."""
    rows = [(k, "Hot text" if k % 3 == 0 else f"text {k % 400} É {'x' * (k % 50)}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    levels = []
    through = exactdedup._through_tables

    def seen(records, table_bytes, combine):
        levels.append(combine)
        return through(records, table_bytes, combine)

    exactdedup._through_tables = seen
    try:
        got = rows_of(exact_duplicates(docs, table_bytes=2000, bucket_bytes=1 << 20, hot=12))
    finally:
        exactdedup._through_tables = through
    assert got == plain_copies(rows) and levels[0] and len(levels) > 4


def test_hashes_that_agree_do_not_make_copies(spark, monkeypatch):
    table = ContentTable(1 << 20)
    assert [table.put(5, c) for c in (b"a", b"b", b"a", b"", b"b", b"")] == [0, 1, 0, 2, 1, 2]
    table = ContentTable(100)
    assert [table.put(k, bytes([k]) * 40) for k in (1, 2, 1, 3, 1)] == [0, -1, 0, -1, 0]  # closed, but it counts on


def test_copies_of_odd_rows_and_empty_tables(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert rows_of(exact_duplicates(odd)) == plain_copies(rows)
    assert exact_duplicates(none).count() == 0 and drop_copies(none).count() == 0
    assert sorted(repr(r["doc_id"]) for r in drop_copies(odd).collect()) == sorted(repr(i) for i in {r[:2] for r in plain_copies(rows) if r[3]} and [r[0] for r in {(r[0], r[4]) for r in plain_copies(rows) if r[3]}])
    nulls = spark.createDataFrame([(None, "A"), (None, "a"), (3, "Ä"), (4, "ä"), (5, None), (6, "")], "doc_id long, text string")
    assert rows_of(exact_duplicates(nulls)) == plain_copies([tuple(r) for r in nulls.collect()])


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_exact_dedup"])
def test_same_rows_as_sql(spark, small_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small_dir}/documents.parquet'")
    got = queries.queries()[name](spark, small_dir)
    result = con.execute(queries.oracle_sql()[name])
    assert [x[0] for x in result.description] == got.columns
    assert sorted(map(tuple, result.fetchall()), key=repr) == rows_of(got.select(*(F.col(c) for c in got.columns)))
