"""Near-duplicates, fingerprints and search against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from echoloom.llm import fingerprints, neardup, search


def brute_components(rows, size, num=80, den=100):
    """Exact components of (id, text) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = neardup.words_of(t)
        sets.setdefault(i, {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if sets[i]]
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            both = len(x & y)
            if den * both >= num * (len(x) + len(y) - both):
                p, q = find(ids[a]), find(ids[b])
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def make_docs(seed, groups=12, copies=10):
    rng = random.Random(seed)
    rows, k = [], 0
    passage = [f"common{j}" for j in range(60)]
    for g in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice((3, 30, 120)))] + (passage if g % 3 == 0 else [])
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice((0, 1, 2, 6, 12))):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
            rows.append((k * 3 % 1009, " ".join(words).replace(" ", rng.choice((" ", "  ", "\n")), 1)))
            k += 1
    rows += [(2000, ""), (2001, None), (2002, "One"), (2003, "ONE"), (2004, " \t"), (2005, "a b c"), (2006, "A b C")]
    return rows


@pytest.mark.parametrize("size,blocks", [(2, {}), (5, {"block_rows": 3, "block_shingles": 200}), (2, {"tried": 0, "block_rows": 4})])
def test_near_duplicates(spark, size, blocks):
    """With small blocks, and with all links left to the blocks, the components are the same."""
    rows = make_docs(size)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, shingle=size, **blocks).collect()}
    assert got == brute_components(rows, size)


def test_large_group_near_the_threshold(spark):
    """One group whose pairs lie on both sides of 0.8, beside exact copies: nothing is lost with its size."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for k in range(400):
        words = list(base)
        for at in rng.sample(range(90), rng.choice((1, 2, 3, 4, 5))):
            words[at] = f"x{rng.randint(0, 10**6)}"
        rows.append((k + 1000, " ".join(words)))
    rows += [(k, rows[0][1].upper()) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, shingle=2, block_rows=64).collect()}
    assert got == brute_components(rows, 2)


@pytest.mark.parametrize("collection", [0, 1])
def test_both_collections_make_the_candidates(spark, monkeypatch, collection):
    """Where no two texts share a half key of one collection, no texts are linked but equal sets."""
    rows = make_docs(4, groups=4)
    plain = neardup.Signer.sign

    def apart(self, s):
        keys, bits = plain(self, s)
        keys = keys.copy()
        own = int(s.sum() % (1 << 60))
        keys[collection * self.halves : (collection + 1) * self.halves] = [hash((own, k)) for k in range(self.halves)]
        return keys, bits

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    linked = {i: c for i, (_, c) in brute_components(rows, 2).items()}  # what both collections give: test_near_duplicates
    monkeypatch.setattr(neardup.Signer, "sign", apart)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, shingle=2).collect()}
    sets = {i: frozenset(neardup.shingle_set(t, 2).tolist()) for i, t in rows}
    assert got == {i: min([j for j in sets if sets[j] == sets[i]] if sets[i] else [i]) for i in sets}
    assert got != linked


def edited(rng, base, share, words):
    return " ".join(f"y{rng.randrange(words)}" if rng.random() < share else w for w in base)


def test_recall_at_the_threshold(spark):
    """Pairs from 0.80 on, each apart from the others: 99 in 100 and more are linked, and no pair below."""
    rng, rows, want = random.Random(5), [], {}
    while len(rows) < 1200:
        base = [f"b{len(rows)}w{k}" for k in range(120)]
        other = list(base)
        for at in rng.sample(range(120), rng.randrange(4, 9)):
            other[at] = f"x{rng.randrange(10**9)}"
        a, b = (set(zip(w, w[1:])) for w in (base, other))
        if 0.78 <= len(a & b) / len(a | b) <= 0.84:
            want[len(rows) + 1] = 100 * len(a & b) >= 80 * len(a | b)
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    got = {r["doc_id"]: not r["kept"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
    there = [i for i, linked in want.items() if linked]
    assert len(there) > 200 and sum(got[i] for i in there) >= 0.99 * len(there) and not any(got[i] for i, linked in want.items() if not linked)


def test_a_large_group_below_the_threshold_moves_rows_in_proportion(spark, monkeypatch):
    """600 texts at about 0.6 of each other, most of which share a table key: pairs and block rows stay few a text."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, edited(rng, base, 0.13, 3000)) for k in range(600)]
    seen, plain = {}, neardup.cut

    def watched(df):
        out = plain(df)
        seen[tuple(out.columns)] = seen.get(tuple(out.columns), 0) + out.count()
        return out

    monkeypatch.setattr(neardup, "cut", watched)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shingle=2).collect()}
    assert got == brute_components(rows, 2)
    assert seen["a", "b"] < 20 * 600 and seen["rep", "n", "component", "second", "one"] < 16 * 600, seen


def test_operators_leave_no_folders(spark):
    """Only what a result is read from stays in the shared folder, until it is released."""
    import os

    from echoloom.llm import common
    from echoloom.shared import shared_dir

    rows = spark.createDataFrame(make_docs(2, groups=3), "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "concat('s', doc_id % 3) AS source", "length(text) AS n_chars")
    folder = shared_dir(spark).removeprefix("file:")
    common.release(spark)
    before = set(os.listdir(folder))
    from echoloom.llm import divergence, exactdedup, importance, mixing, packing, quality

    for run in (
        lambda: neardup.near_duplicates(rows), lambda: neardup.keep_one(rows), lambda: search.search(rows, rows.limit(3), k=2), lambda: packing.pack(rows), lambda: mixing.mix(rows), lambda: mixing.draws(rows),
        lambda: divergence.source_divergence(rows), lambda: exactdedup.drop_copies(rows), lambda: importance.resample(rows, rows), lambda: quality.quality_scores(rows, quality.fit_quality(rows)),
    ):
        run().write.format("noop").mode("overwrite").save()
        left = {x for x in set(os.listdir(folder)) - before if not x.endswith(".crc")}
        assert len(left) <= 2, left
        common.release(spark)
        assert set(os.listdir(folder)) == before


def test_names_that_clash_with_own_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 7, 8), (2, "a b c d e f", 9, 1)], "doc_id long, text string, __near_gone long, __near_of long")
    got = neardup.keep_one(docs)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "a b c d e f", 7, 8)]


def test_texts_of_one_id(spark):
    """An id with two texts has the links of both; one row of each of its texts stays."""
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, a), (1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, "c d e f g h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs, shingle=2).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)} and len(got) == 6
    assert sorted(tuple(r) for r in neardup.keep_one(docs, shingle=2).collect()) == [(1, a), (1, b), (4, "c d e f g h")]


def test_near_duplicates_odd(odd, none):
    got = neardup.near_duplicates(odd, shingle=2).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert len(got) == 10 and by[2]["component_id"] == 1 and not by[2]["kept"] and by[1]["kept"] and by[4]["kept"] and by[3]["n_shingles"] == 0
    assert all(r["kept"] for r in got if r["doc_id"] is None)
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.keep_one(odd, shingle=5)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 1, 3, 4, 5, 6, 7]
    assert neardup.keep_one(none).count() == 0


def test_block_links_span_all_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 10**6, 60)
    sets = [np.unique(np.where(rng.random(60) < 0.12, rng.integers(0, 10**6, 60), base)) for _ in range(40)]
    found = [(i, j) for i, j in neardup.block_links(np.arange(40), np.ones(40, bool), sets, np.zeros((40, 1), int), 80, 100, width=16) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    labels = list(range(40))
    for pairs in (found, [(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]):
        parent = list(range(40))
        for i, j in pairs:
            a, b = i, j
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
        roots = []
        for x in range(40):
            while parent[x] != x:
                x = parent[x]
            roots.append(x)
        labels, before = roots, labels
    assert labels == before


def test_connected_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["component"] for r in neardup.connected(links).collect()}
    assert got == {**{k: 0 for k in range(201)}, 500: 500, 501: 500}


def gram_counts(t):
    w = t.split()
    return Counter(zip(w, w[1:])) if len(w) > 1 else Counter(w)


def test_fingerprints_estimate_generalised_jaccard(spark):
    rng = random.Random(4)
    rows = [(k * 7, " ".join(rng.choices([f"w{j}" for j in range(25)], k=rng.randint(1, 300)))) for k in range(60)] + [(1000, ""), (1001, None), (1002, "a"), (1003, "déjà vu " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fingerprints.fingerprint_in_order(docs, samples=256).orderBy("doc_id").collect()
    errors = []
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        g = got[k]
        assert (g["doc_id"], g["n_chars"], g["edited_sha256"]) == (i, len(t), hashlib.sha256(edited.encode()).hexdigest())
        for other, value in ((edited, g["near_edited"]), (following, g["near_next"])):
            a, b = gram_counts(t), gram_counts(other)
            true = sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0
            errors.append(value - true)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05
    assert got[60]["fingerprint"] == "0" * 1024 == got[61]["fingerprint"] and got[60]["near_next"] == 1.0


def test_ranges_have_equal_bytes(spark):
    """Long texts stand at the first ids: ranges of equal rows would give one task nearly all of the bytes."""
    rows = [(k, "word " * (2000 if k < 200 else 2)) for k in range(2000)]
    docs = spark.createDataFrame(rows, "place long, text string").selectExpr("place", "xxhash64(text) AS h", "text").repartition(3)
    ranges = fingerprints.byte_ranges(docs, 8)
    sizes = Counter()
    for k, t in rows:
        sizes[int(np.searchsorted(ranges.bounds, k, "right"))] += len(t)
    assert len(ranges.heads) == len(ranges.bounds) + 1 <= 8 and max(sizes.values()) <= 1.6 * sum(sizes.values()) / 8
    assert [h[0] for h in ranges.heads] == [0, *ranges.bounds]
    got = docs.select("place", ranges.part(docs["place"]).alias("part")).collect()
    assert all(r["part"] == np.searchsorted(ranges.bounds, r["place"], "right") for r in got)


def test_fingerprints_odd(odd, none):
    got = fingerprints.fingerprint_in_order(odd).collect()
    assert len(got) == 10 and fingerprints.fingerprint_in_order(none).count() == 0
    same = {r["fingerprint"] for r in got if r["doc_id"] in (1, 2)}
    assert len(same) == 1 and fingerprints.fingerprint(odd).filter("doc_id = 1").first()["fingerprint"] in same


def brute_search(rows, asked, k, k1=1.2, b=0.75):
    docs = [(i, Counter(search.terms_of(t))) for i, t in rows]
    n, mean = len(docs), sum(c.total() for _, c in docs) / len(docs)
    df = Counter(t for _, c in docs for t in c)
    out = {}
    for q, text in asked:
        terms = set(search.terms_of(text))
        scored = []
        for i, c in docs:
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * c.total() / mean)) for t in terms if t in c)
            if s > 0:
                scored.append((-round(s, 9), i))
        out[q] = sorted(scored)[:k]
    return out


def test_search(spark):
    rng = random.Random(6)
    common, rare = [f"c{j}" for j in range(12)], [f"r{j}" for j in range(800)]
    rows = [(k, " ".join(rng.choices(common, k=rng.randint(0, 25)) + rng.choices(rare, k=rng.randint(0, 12)))) for k in range(700)]
    rows += [(k + 700, rows[k][1]) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for r in search.search(docs, docs.filter("doc_id % 10 = 0"), k=7, shard_rows=150, queries_at_once=30).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["doc_id"]))
    want = {q: x for q, x in brute_search(rows, [r for r in rows if r[0] % 10 == 0], 7).items() if x}
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
    assert all(abs(s + w) < 1e-6 for q, x in got.items() for (s, _), (w, _) in zip(x, want[q]))


def test_search_skips_blocks(spark):
    """Texts of four vocabularies with Zipf-like words: most blocks are skipped, and the best stay exact."""
    rng = random.Random(9)
    words = {lang: [f"{lang}{j}" for j in range(900)] for lang in "abcd"}
    rows = [(k, " ".join(rng.choices(words[rng.choice("abcd")], weights=[1 / (j + 3) for j in range(900)], k=rng.randint(20, 120)))) for k in range(1500)]
    asked = rows[:60]
    index = search.build_index(spark.createDataFrame(rows, "id long, text string").coalesce(2), 500, 1 << 30).collect()
    df = Counter(t for _, text in rows for t in set(search.terms_of(text)))
    n, mean = len(rows), sum(r["total"] for r in index) / len(rows)
    lists = [sorted(set(search.terms_of(t))) for _, t in asked]
    weight = np.array([math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for x in lists for t in x])
    walk = search.Walk(np.array([len(x) for x in lists]), search._hashes([t for x in lists for t in x]), weight, 5)
    for r in index:
        walk.over(search.Shard(*(np.array(r[c]) for c in ("ids", "lengths", "terms", "starts", "place", "count")), mean, 1.2, 0.75))
    got = {}
    for q, i, s in zip(*walk.best()):
        got.setdefault(asked[q][0], []).append((round(-float(s), 6), int(i)))
    assert got == {q: [(round(s, 6), i) for s, i in x] for q, x in brute_search(rows, asked, 5).items()}
    assert walk.met == 60 * sum(-(-len(r["ids"]) // search.BLOCK) for r in index) and walk.scored < 0.5 * walk.met


def test_search_map_rows_are_bounded(spark, monkeypatch):
    """The map gives k rows a query and group; groups hold a number of shards each, so tasks grow with the index."""
    rows = [(k, f"w{k % 7} x{k % 11} y") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    a = search.search(docs, docs.filter("doc_id % 100 = 0"), k=4, shard_rows=10, groups=3).orderBy("query_id", "rank").collect()
    b = search.search(docs, docs.filter("doc_id % 100 = 0"), k=4, slice_queries=2, side_by_side=1).orderBy("query_id", "rank").collect()
    assert a == b and len(a) == 24
    tasks, plain = [], search.cut
    monkeypatch.setattr(search, "cut", lambda df: (tasks.append(df._jdf.queryExecution().executedPlan().toString()), plain(df))[1])
    c = search.search(docs, docs.filter("doc_id % 100 = 0"), k=4, shard_rows=10, group_shards=2).orderBy("query_id", "rank").collect()
    assert c == a and "Coalesce 32" in tasks[0] and tasks[0].count("Window [") == 2  # 64 shards in 32 tasks, merged in two levels


def test_search_one_query_of_an_id(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c d"), (2, "a"), (3, "c")], "doc_id long, text string")
    got = search.search(docs, docs.filter("doc_id = 1"), k=9).collect()
    assert {r["query_id"] for r in got} == {1} and len({r["doc_id"] for r in got} & {2, 3}) == 1


def test_search_odd(odd, none):
    got = search.search(odd, odd, k=3).collect()
    assert {r["query_id"] for r in got} == {1, 2, 5, 6} and all(r["score"] > 0 for r in got)
    assert search.search(none, odd).count() == 0 == search.search(odd, none).count()


def test_near_duplicate_sql():
    import duckdb

    from echoloom.llm import queries

    rows = make_docs(2)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = con.execute(queries.oracle_sql()["op3_near_duplicates"]).fetchall()
    assert {i: (n, c) for i, n, c, _ in got} == brute_components(rows, 2) and all(k == (i == c) for i, _, c, k in got)


def test_a_packed_index_has_the_same_arrays_in_small_row_groups(spark, monkeypatch):
    """Arrays pass as bytes, and a reader holds a few shards: row groups of 128 MB were decoded whole, in each task."""
    rng, kept = random.Random(8), {}
    rows = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(300)))) for i in range(400)] + [(400, "same " * 70_000), (401, None)], "id long, text string").coalesce(1)
    plain, packed = (search.build_index(rows, 150, 1 << 30, packed=p).collect() for p in (False, True))
    assert len(plain) == len(packed) == 3
    for a, b in zip(plain, packed, strict=True):
        assert (a["n"], a["total"]) == (b["n"], b["total"])
        for c in ("ids", "lengths", "terms", "starts", "place", "count"):
            assert search._unpacked(c, bytes(b[c])).tolist() == a[c], c
    store = search.store
    monkeypatch.setattr(search, "store", lambda df, **options: (kept.setdefault("options", options), store(df, **options))[1])
    search.search(rows, rows.limit(3), id_col="id", k=2)
    assert int(kept["options"]["parquet.block.size"]) <= 16 << 20
