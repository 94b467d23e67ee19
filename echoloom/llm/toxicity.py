"""Toxicity scores by a factorization machine over hashed terms.

The terms of a text are its distinct lower-cased words and the beginnings of longer words (4 to 6 letters, so
inflected forms share a term), hashed to ``2**HASH_BITS`` buckets. The machine scores
``b + sum w_i + sum_{i<j} <v_i, v_j>`` over the terms present, so pairs of terms count beyond their own weights.
It is fitted on the driver on a bounded sample of labelled rows; every whole text is scored by a narrow map.
All terms of the sample are screened, alone and in pairs, and each one that passes has a weight and factors: a term
whose rows differ in their labels, and both terms of a pair whose common rows differ more than by either term.

Null and empty texts have no terms and get the score of the intercept. Without labels of both classes every
score is the share of label 1 (0 without labels). Repeated rows are scored each; a document with several
labels has the largest. Very long texts are read whole; their terms are a set. An empty table gives an empty result;
other columns, whatever they are called, are not read. Ties can't arise, as nothing is ranked.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

HASH_BITS = 20
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")


def word_terms(word: str, bits: int = HASH_BITS) -> tuple[int, ...]:
    """The hashed terms of a lower-cased word."""
    keep = (1 << bits) - 1
    return (crc32(word.encode()) & keep, *(crc32(f"{n}^{word[:n]}".encode()) & keep for n in PREFIXES if len(word) > n))


def text_words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


class FactorizationMachine:
    """Second-order machine over binary features; ``slot`` maps a bucket to its row of the parameters."""

    def __init__(self, slot: dict[int, int], bias: float, weight: np.ndarray, factor: np.ndarray) -> None:
        self.slot, self.bias, self.weight, self.factor = slot, bias, weight, factor

    def raw(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        s = self.bias + np.bincount(row, self.weight[feature], n)
        for v in self.factor.T:
            x = v[feature]
            s = s + 0.5 * (np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n))
        return s

    def score(self, rows: list[set[int]]) -> list[float]:
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        feature = np.fromiter((f for r in rows for f in r), np.int64, len(row))
        return (1 / (1 + np.exp(-np.clip(self.raw(row, feature, len(rows)), -40, 40)))).tolist()


def _ratio(with_one: np.ndarray, seen: np.ndarray, ones: float, n: int) -> np.ndarray:
    """Log-likelihood ratios of labels in rows that hold something against the others."""
    table = np.stack([with_one, seen - with_one, ones - with_one, n - seen - ones + with_one])
    margins = np.stack([seen * ones, seen * (n - ones), (n - seen) * ones, (n - seen) * (n - ones)]) / n
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * np.where(table > 0, table * np.log(table / np.maximum(margins, 1e-12)), 0).sum(0)


def _counts(rows: list[np.ndarray], label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buckets; of each entry its row and bucket's number; of each bucket its rows with label 1 and all its rows."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    ids, inverse, seen = np.unique(np.concatenate(rows).astype(np.int64), return_inverse=True, return_counts=True)
    return ids, owner, inverse, np.bincount(inverse, label[owner], len(ids)), seen


def select_features(rows: list[np.ndarray], label: np.ndarray, most: int | None = None, least_rows: int = 3) -> np.ndarray:
    """Buckets in enough rows whose rows differ from the others in their labels; the first ``most`` if it is given."""
    if not rows or label.min() == label.max():
        return np.empty(0, np.int64)
    ids, _, _, with_one, seen = _counts(rows, label)
    g = _ratio(with_one, seen, label.sum(), len(rows))
    g[seen < least_rows] = 0
    best = np.argsort(-g, kind="stable")[:most]
    return np.sort(ids[best[g[best] > 10.83]])  # 10.83: chi-square of one degree at 0.001


def select_pairs(rows: list[np.ndarray], label: np.ndarray, error: float = 0.05, block: int = 1024) -> np.ndarray:
    """Pairs of buckets whose common rows differ in their labels by more than the rows of either one do.

    All pairs that can pass are counted: common rows of one label alone bound the ratio, so terms in fewer rows than
    reach the threshold have no such pair. The threshold is for ``error`` expected false pairs among all counted.
    """
    none = np.empty((0, 2), np.int64)
    if not rows or label.min() == label.max():
        return none
    n, ones = len(rows), float(label.sum())
    ids, owner, inverse, with_one, seen = _counts(rows, label)
    able = np.ones(len(ids), bool)
    for _ in range(3):  # the threshold depends on the number of pairs that can reach it
        most = max(2, int(able.sum()))
        least = 2 * np.log(most * (most - 1) / 2 / error)
        able = np.maximum(_ratio(with_one, with_one, ones, n), _ratio(np.zeros(len(ids)), seen - with_one, ones, n)) >= least
    able = np.flatnonzero(able)
    if len(able) < 2:
        return none
    number = np.full(len(ids), -1)
    number[able] = np.arange(len(able))
    held = number[inverse] >= 0
    column, row = number[inverse[held]], owner[held]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    alone = _ratio(with_one[able], seen[able], ones, n)
    place = np.cumsum(label) - 1  # the number of a row among those of its label
    place = np.where(label > 0, place, np.arange(n) - place - 1).astype(np.int64)
    sizes = {1: int(ones), 0: n - int(ones)}

    def dense(at: int, one: int) -> np.ndarray:
        a, b = np.searchsorted(column, (at, at + block))
        of = label[row[a:b]] == one
        out = np.zeros((sizes[one], min(block, len(able) - at)), np.float32)
        out[place[row[a:b][of]], column[a:b][of] - at] = 1
        return out

    out = []
    for i in range(0, len(able), block):
        left = dense(i, 1).T.copy(), dense(i, 0).T.copy()
        for j in range(i, len(able), block):
            pos, neg = left[0] @ dense(j, 1), left[1] @ dense(j, 0)
            x, y = np.nonzero((pos + neg > 0) & (np.arange(i, i + pos.shape[0])[:, None] < np.arange(j, j + pos.shape[1])))
            pos, both = pos[x, y].astype(float), (pos[x, y] + neg[x, y]).astype(float)
            far = np.abs(pos - both * ones / n) > 1  # a row more or less reaches no threshold; cheaper than the ratio
            x, y, pos, both = x[far], y[far], pos[far], both[far]
            good = _ratio(pos, both, ones, n) - np.maximum(alone[i + x], alone[j + y]) >= least
            out.append(np.stack([ids[able[i + x[good]]], ids[able[j + y[good]]]], 1))
    return np.concatenate(out)


def fit(rows: list[np.ndarray], label: np.ndarray, *, factors: int = 4, steps: int = 120, rate: float = 0.05, decay: float = 2e-4, seed: int = 7) -> FactorizationMachine:
    """Adam on the whole sample; ``rows`` are the distinct buckets of each text."""
    n = len(rows)
    share = float(label.mean()) if n else 0.0
    bias = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    ids = np.union1d(select_features(rows, label, None), select_pairs(rows, label).ravel())
    slot = {int(b): k for k, b in enumerate(ids)}
    rng = np.random.default_rng(seed)
    p = [np.array([bias]), np.zeros(len(ids)), rng.normal(0, 0.05, (len(ids), factors))]
    if len(ids):
        found = [np.fromiter((slot[b] for b in r.tolist() if b in slot), np.int64) for r in rows]
        row = np.repeat(np.arange(n), [len(r) for r in found])
        feature = np.concatenate(found)
        m1, m2 = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
        for step in range(1, steps + 1):
            sums = np.stack([np.bincount(row, v[feature], n) for v in p[2].T], 1)
            fm = FactorizationMachine(slot, p[0][0], p[1], p[2])
            error = 1 / (1 + np.exp(-np.clip(fm.raw(row, feature, n), -40, 40))) - label
            each = error[row]
            grad = [np.array([error.mean()]), np.bincount(feature, each, len(ids)) / n + decay * p[1]]
            count = np.bincount(feature, each, len(ids))
            grad.append(np.stack([np.bincount(feature, each * sums[row, k], len(ids)) - p[2][:, k] * count for k in range(factors)], 1) / n + decay * p[2])
            for x, g, a, b in zip(p, grad, m1, m2, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return FactorizationMachine(slot, float(p[0][0]), p[1], p[2])


def _terms_map():
    known: dict[str, tuple[int, ...]] = {}

    def terms(text: str | None) -> set[int]:
        out: set[int] = set()
        for w in text_words(text):
            t = known.get(w)
            if t is None:
                if len(known) >= 200_000:
                    known.clear()
                t = known[w] = word_terms(w)
            out.update(t)
        return out

    return terms


def training_rows(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed terms and labels of the ``sample`` labelled rows with the smallest hash of their id.

    At most ``sample`` ids are broadcast. Of several texts of an id the one with the smallest terms is taken.
    """
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(sample)
    pairs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id")
    kind = dict(pairs.dtypes)["id"]

    def make():
        terms = _terms_map()
        return lambda x: {"id": x["id"], "terms": [sorted(terms(t)) for t in x["text"]], "y": x["y"]}

    got = map_texts(pairs, ["id", "text", "y"], make, f"id {kind}, terms array<int>, y double").groupBy("id").agg(F.min("terms").alias("terms"), F.max("y").alias("y")).orderBy("id").toArrow()
    return [np.array(r, np.int64) for r in got.column("terms").to_pylist()], np.array(got.column("y").to_pylist(), float)


def score_texts(docs: DataFrame, model: FactorizationMachine, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and score (0 to 1)."""

    def make():
        slot, known = model.slot, {}

        def features(word: str) -> tuple[int, ...]:
            got = known.get(word)
            if got is None:
                if len(known) >= 400_000:
                    known.clear()
                got = known[word] = tuple(slot[t] for t in word_terms(word) if t in slot)
            return got

        return lambda x: {"id": x[id_col], "score": model.score([set().union(*map(features, text_words(t))) for t in x[text_col]])}

    kind = dict(docs.dtypes)[id_col]
    return map_texts(docs, [id_col, text_col], make, f"id {kind}, score double").select(F.col("id").alias(id_col), "score")


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 8_000) -> DataFrame:
    """Fits on at most ``sample`` labelled rows and scores every row of ``docs``."""
    rows, y = training_rows(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample)
    return score_texts(docs, fit(rows, y), id_col=id_col, text_col=text_col)
