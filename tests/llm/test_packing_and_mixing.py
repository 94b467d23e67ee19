"""Buckets, batches and mixtures."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from echoloom.llm import mixing, packing


def padding(lengths, counts, bounds):
    return sum(c * next(b for b in bounds if b >= n) for n, c in zip(lengths, counts))


@pytest.mark.parametrize("buckets", [1, 2, 3, 5])
def test_boundaries_are_optimal(buckets):
    rng = np.random.default_rng(buckets)
    lengths, counts = np.sort(rng.choice(60, 9, replace=False)), rng.integers(1, 20, 9)
    got = packing.choose_boundaries(lengths, counts, buckets)
    best = min(padding(lengths, counts, sorted({*c, lengths[-1]})) for r in range(buckets) for c in itertools.combinations(lengths[:-1].tolist(), r))
    assert len(got) <= buckets and padding(lengths, counts, got) == best


def test_batches(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(["w"] * int(rng.paretovariate(0.8)))[:60_000]) for k in range(800)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), buckets=6, batch_tokens=500, shard_rows=40).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(800)) and all(r["length"] == len(rows[r["doc_id"]][1].split()) <= r["padded_length"] for r in got)
    batches = {}
    for r in got:
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (bucket, n), rs in batches.items():
        room = max(1, 500 // max(1, rs[0]["padded_length"]))
        assert sorted(r["slot"] for r in rs) == list(range(len(rs))) and len(rs) <= room
        assert len(rs) == room or n == max(m for b, m in batches if b == bucket)  # only the last may be short


def test_long_lengths_are_exact(spark):
    rows = [(k, "w " * (2079 if k == 0 else 2050)) for k in range(20)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), buckets=2).collect()
    assert all(r["padded_length"] == r["length"] for r in got) and len({r["bucket"] for r in got}) == 2
    rng = np.random.default_rng(4)
    lengths, counts = np.sort(rng.choice(20_000, 300, replace=False)), rng.integers(1, 50, 300)
    best = [[lengths[j] * counts[: j + 1].sum() for j in range(300)]]
    for _ in range(6):
        best.append([min(best[-1][j], *(best[-1][i] + lengths[j] * counts[i + 1 : j + 1].sum() for i in range(j)), np.inf) for j in range(300)])
    assert padding(lengths, counts, packing.choose_boundaries(lengths, counts, 7)) == best[-1][-1]


def test_pack_odd(odd, none):
    got = packing.pack(odd, keep=["source"]).collect()
    assert len(got) == 10 and {r["length"] for r in got if r["doc_id"] in (3, 4, 7)} == {0}
    assert packing.pack(none).count() == 0


def plain_sums(tokens):
    total = sum(tokens)
    return lambda exponents: [(sum((t / total) ** a for t in tokens if t), sum((t / total) ** a * math.log(t / total) for t in tokens if t)) for a in exponents]


def plain_weights(tokens, a):
    """Weights at an exponent and their entropy, from the definition."""
    raw = [t**a for t in tokens]
    w = [x / sum(raw) for x in raw]
    return w, -sum(x * math.log(x) for x in w)


def test_exponent():
    tokens = [1000, 100, 10]
    natural = plain_weights(tokens, 1.0)[1]
    a = mixing.choose_exponent(plain_sums(tokens), 3, 10 / 1110, 1.0, 0.8, None)
    assert natural < 0.8 * np.log(3) and abs(plain_weights(tokens, a)[1] - 0.8 * np.log(3)) < 1e-6
    r = mixing.choose_exponent(plain_sums(tokens), 3, 10 / 1110, 1.0, None, 3.0)
    assert abs(max(w * 1110 / t for w, t in zip(plain_weights(tokens, r)[0], tokens)) - 3) < 1e-6
    assert mixing.choose_exponent(plain_sums(tokens), 3, 10 / 1110, 1.0, 0.8, 3.0) == max(a, r)
    assert mixing.choose_exponent(plain_sums([5]), 1, 1.0, 1.0, 0.8, 2) == 1.0
    assert mixing.choose_exponent(plain_sums([5, 5]), 2, 0.5, 1.0, 0.9, None) == 1.0  # nothing reaches an entropy below the natural one
    assert mixing.choose_exponent(plain_sums([5, 4]), 2, 4 / 9, 1.0, 1.0, None) < 1e-9


def brute_mixture(docs, target, repeats):
    """The whole sequence of each source, in plain loops: [(doc_id, pass)]. Places are hashes of seed, pass and row."""
    row = "xxhash64(doc_id, source, text)"
    rows = docs.selectExpr("doc_id", "source", "text", *(f"shiftrightunsigned(xxhash64(5, {p}, {row}), 16) AS p{p}" for p in range(1, 8))).collect()
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    words = {s: sum(len((r["text"] or "").split()) for r in rs) for s, rs in by.items()}
    full = [s for s in words if words[s]]
    budget = sum(words.values())

    def good(a):
        w, e = plain_weights([words[s] for s in full], a)
        return e <= target * math.log(len(full)) and all(x * budget / words[s] <= repeats for x, s in zip(w, full))

    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if good(middle) else (middle, high)
    quota = dict(zip(full, (w * budget for w in plain_weights([words[s] for s in full], high)[0])))
    out = {}
    for s, rs in by.items():
        out[s], left, p = [], quota.get(s, 0.0), 1
        while words[s] and left >= words[s] * (1 - 1e-9):
            out[s] += [(r["doc_id"], p) for r in sorted(rs, key=lambda r: r[f"p{p}"])]
            left, p = left - words[s], p + 1
        for r in sorted(rs, key=lambda r: r[f"p{p}"]) if words[s] else []:
            left -= len((r["text"] or "").split())
            if left < 0:
                break
            out[s].append((r["doc_id"], p))
        if not words[s]:
            out[s] = [(r["doc_id"], 1) for r in sorted(rs, key=lambda r: r["p1"])]
    return out


@pytest.mark.parametrize("most,cell", [(10_000, 2_000), (1, 50)])
def test_mixture(spark, monkeypatch, most, cell):
    """Against plain loops; with one broadcast source the others take the shuffled join."""
    monkeypatch.setattr(mixing, "CELL_ROWS", cell)
    rng = random.Random(2)
    rows = [(k, "w " * rng.randint(1, 40), "big" if k % 10 else ("mid" if k % 20 else ("tiny" if k % 40 else None))) for k in range(2000)] + [(9000 + k, "", "none") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = {"target_entropy": 0.85, "most_repeats": 4.0, "most_sources": most}
    want = brute_mixture(docs, 0.85, 4.0)
    got = {}
    for r in mixing.draws(docs, **options).orderBy("position").collect():
        got.setdefault(r["source"], []).append((r["doc_id"], r["pass"], r["position"]))
        assert r["n_tokens"] == len(rows[r["doc_id"]][1].split()) if r["doc_id"] < 9000 else r["n_tokens"] == 0
    assert {s: [x[:2] for x in v] for s, v in got.items()} == want
    assert all([x[2] for x in v] == list(range(1, len(v) + 1)) for v in got.values())
    first, second = ([x[0] for x in got["mid"] if x[1] == n] for n in (1, 2))
    assert second and [i for i in first if i in set(second)] != second  # each pass is a permutation of its own
    copies = Counter((r["doc_id"], r["source"]) for r in mixing.mix(docs, **options).collect())
    assert copies == Counter((i, s) for s, v in want.items() for i, _ in v)


def test_mix_odd(odd, none):
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.filter("source IS NULL").count() >= 1
    assert mixing.mix(none).count() == 0 == mixing.draws(none).count()
    named = odd.withColumnsRenamed({"id": "__mixture", "rep": "of", "place": "docs", "part": "__mixture_of"})
    assert mixing.mix(named).columns == named.columns
    drawn = mixing.draws(odd).collect()
    assert len(drawn) == mixed.count() and len({(r["source"], r["position"]) for r in drawn}) == len(drawn)
