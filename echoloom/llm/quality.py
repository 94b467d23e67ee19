"""Document quality by weak labels.

Several heuristic labellers each vote good, bad or nothing on a text. The counts of all vote patterns (at most
3 to the number of labellers) go to expectation-maximisation, which estimates the labellers' accuracies and the
share of good texts, with votes taken as independent given the kind of a text: good, or one of a few kinds of bad.
The posterior of each pattern labels its texts, and a logistic scorer over hashed features (word shapes and binned
statistics) learns from the posteriors of a bounded sample. No gold labels are used. Every whole text is counted
and scored.

Null and empty texts have no words: they get a bad vote for length and no others. An empty table gives an empty
result. Repeated rows are scored each.
"""

from __future__ import annotations

import re
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, map_texts, operator, replace_batches, store

#: Frequent short words of English, French, German and Spanish.
COMMON_WORDS = frozenset(
    "the of and to in is that it for was on with as be at by this are or from an a he "
    "le la les de des du et un une est que qui dans pour par au aux en sur pas il elle "
    "der die das den dem des und ist von zu mit ein eine für auf nicht im "
    "el los las del y se su con para como lo es".split()
)
FEATURE_BITS = 12
LABELLERS = ("length", "symbols", "capitals", "separators", "variety", "common_words", "word_length", "word_repeats", "line_repeats", "digits")
_RUNS = re.compile(r"(.)\1+", re.S)
_SHAPE = str.maketrans({**{chr(c): "a" for c in range(0x61, 0x7B)}, **{chr(c): "A" for c in range(0x41, 0x5B)}, **{chr(c): "9" for c in range(0x30, 0x3A)}, **{c: "a" for c in "àâäáãåæçèéêëìíîïñòóôöõøùúûüýÿßœ"}, **{c: "A" for c in "ÀÂÄÁÃÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÖÕØÙÚÛÜÝŒ"}})
_BYTE_KIND = np.zeros(256, np.int64)  # 0 letters and the bytes of longer characters, 1 capitals, 2 digits, 3 white space, 4 . and , and the like, 5 other symbols
_BYTE_KIND[0x41:0x5B] = 1
_BYTE_KIND[0x30:0x3A] = 2
_BYTE_KIND[[*range(9, 14), 0x20]] = 3
_BYTE_KIND[[ord(c) for c in ".,;:'\"()-?"]] = 4
_BYTE_KIND[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 5


def statistics(text: str | None) -> tuple[dict[str, float], list[str]]:
    """Shares that the labellers vote on, and the words."""
    text = text or ""
    words = text.split()
    n = max(1, len(words))
    kinds = np.bincount(_BYTE_KIND[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], minlength=6)
    letters = max(1, int(kinds[0] + kinds[1]))
    lines = [x for x in text.split("\n") if x.strip()]
    return {
        "words": len(words),
        "symbols": int(kinds[5]) / max(1, int(kinds.sum() - kinds[3])),
        "capitals": int(kinds[1]) / letters,
        "separators": sum(map(text.count, ("|", "\t", ";"))) / n,
        "variety": len(set(words)) / n,
        "common_words": sum(map(COMMON_WORDS.__contains__, words)) / n,
        "word_length": (len(text) - int(kinds[3])) / n,
        "word_repeats": sum(map(eq, words, words[1:])) / n,
        "line_repeats": 1 - len(set(lines)) / max(1, len(lines)),
        "digits": int(kinds[2]) / max(1, int(kinds.sum())),
    }, words


def votes(s: dict[str, float]) -> str:
    """One character a labeller: g good, b bad, - nothing. Between its two bounds a labeller gives no vote."""

    def by(heard: bool, good: bool, bad: bool) -> str:
        return "-" if not heard else "g" if good else "b" if bad else "-"

    some, many = s["words"] > 0, s["words"] >= 40  # repeated words and lines say little about short texts
    return "".join(
        (
            by(True, s["words"] >= 5, not some),
            by(some, s["symbols"] < 0.03, s["symbols"] > 0.08),
            by(some, s["capitals"] < 0.2, s["capitals"] > 0.5),
            by(some, s["separators"] < 0.05, s["separators"] > 0.15),
            by(many, s["variety"] > 0.3, s["variety"] < 0.05),
            by(some, s["common_words"] > 0.12, many and s["common_words"] < 0.01),
            by(some, 2.5 < s["word_length"] < 7, not 1.8 < s["word_length"] < 14),
            by(many, s["word_repeats"] < 0.1, s["word_repeats"] > 0.2),
            by(many, s["line_repeats"] < 0.5, s["line_repeats"] > 0.8),
            by(some, s["digits"] < 0.2, s["digits"] > 0.3),
        )
    )


def hashed_features(s: dict[str, float], words: list[str], known: dict[str, int], bits: int = FEATURE_BITS) -> dict[int, float]:
    """Shares of hashed word shapes, and a feature for each statistic's bin."""
    keep = (1 << bits) - 1
    n = max(1, len(words))
    shape: dict[int, int] = {}
    for w in words:
        b = known.get(w)
        if b is None:
            if len(known) >= 300_000:
                known.clear()
            b = crc32(_RUNS.sub(r"\1", w.translate(_SHAPE)).encode("utf-8", "surrogatepass")) & keep
            if len(w) <= 64:  # longer words are seldom met again
                known[w] = b
        shape[b] = shape.get(b, 0) + 1
    out = {b: (c / n) ** 0.5 for b, c in shape.items()}
    for name, x in s.items():
        level = int(np.floor(np.log2(x + 1))) if name in ("words",) else int(x * 2) if name == "word_length" else int(np.floor(12 * min(1.0, x) ** 0.5))
        out[crc32(f"{name}={level}".encode()) & keep] = 1.0
    return out


class LabelModel:
    """The accuracies of the labellers and the share of good texts, by expectation-maximisation.

    A text is of one hidden kind, and its votes (good, bad or none) are independent given the kind. Since symptoms of bad
    texts exclude each other more than independence allows, bad texts can be of several kinds: kinds are added, each
    begun at the texts that one labeller calls bad, as long as the Bayesian information criterion rises. The first step
    takes texts without a bad vote as good, and the kind that holds most of these is good. Any other kind is bad
    where some labeller calls a tenth of it bad at least, and clearly more of it bad than good. ``share`` holds the
    shares of the kinds and ``vote_given`` the shares of good votes, bad votes and none of each labeller on them.
    """

    def __init__(self, patterns: dict[str, int], most_kinds: int | None = None, steps: int = 2000) -> None:
        self.index = {p: k for k, p in enumerate(sorted(patterns))}
        self.count = np.array([patterns[p] for p in self.index], float)
        m = len(next(iter(self.index), ""))
        cast = np.array([["gb-".index(c) for c in p] for p in self.index], np.int64).reshape(len(self.index), m)
        self.votes = np.eye(3)[cast].reshape(len(self.index), 3 * m)  # pattern, labeller and vote
        self.share, self.vote_given, self.bad_kind = np.array([0.5, 0.5]), np.full((2, m, 3), 1 / 3), np.array([False, True])
        self.post, self.right = np.empty(0), np.full((m, 2), np.nan)
        if not self.count.sum():
            return
        bad = (cast == 1).any(1)
        like, belongs = self._settle(np.stack([np.where(bad, 0.1, 0.9), np.where(bad, 0.9, 0.1)], 1), steps)
        while belongs.shape[1] - 1 < (m if most_kinds is None else most_kinds):
            tries = []
            for voted in (cast == 1).T:
                new = np.where(voted, 0.9, 0.02)[:, None]
                tries.append(self._settle(np.concatenate([belongs * (1 - new), new], 1), 60))
            further = self._settle(max(tries, key=lambda x: x[0])[1], steps)
            if further[0] - like <= 0.5 * (2 * m + 1) * np.log(self.count.sum()):
                break
            like, belongs = further
        self._settle(belongs, 1)
        weight = self.count[:, None] * belongs
        good, called_bad, _ = np.moveaxis((weight.T @ self.votes).reshape(-1, m, 3), 2, 0)
        self.bad_kind = ((called_bad - good > np.sqrt(called_bad + good)) & (called_bad >= 0.1 * weight.sum(0)[:, None])).any(1)
        if not bad.all():
            self.bad_kind[weight[~bad].sum(0).argmax()] = False
        self.post = belongs[:, ~self.bad_kind].sum(1)
        voted = good + called_bad
        with np.errstate(invalid="ignore"):
            self.right = np.stack([called_bad[self.bad_kind].sum(0) / voted[self.bad_kind].sum(0), good[~self.bad_kind].sum(0) / voted[~self.bad_kind].sum(0)], 1)

    def _settle(self, belongs: np.ndarray, steps: int) -> tuple[float, np.ndarray]:
        """Turns of both steps until the log-likelihood stands; it, and the posteriors of the kinds for each pattern."""
        like = -np.inf
        for _ in range(steps):
            weight = self.count[:, None] * belongs
            self.share = (weight.sum(0) + 0.5) / (weight.sum() + 0.5 * belongs.shape[1])
            seen = (weight.T @ self.votes).reshape(belongs.shape[1], -1, 3) + 0.5
            self.vote_given = seen / seen.sum(2, keepdims=True)
            odds = np.log(self.share) + self.votes @ np.log(self.vote_given.reshape(belongs.shape[1], -1).T)
            top = odds.max(1, keepdims=True)
            each = np.exp(odds - top)
            belongs = each / each.sum(1, keepdims=True)
            before, like = like, float((self.count * (top[:, 0] + np.log(each.sum(1)))).sum())
            if like - before < 1e-10 * abs(like):
                break
        return like, belongs

    @property
    def prior(self) -> float:
        """The share of good texts."""
        return float((self.count * self.post).sum() / self.count.sum()) if len(self.post) else 0.5

    def accuracies(self) -> np.ndarray:
        """Of each labeller on bad and on good texts: the share of right votes among its votes."""
        return self.right

    def posterior(self, pattern: str) -> float:
        return float(self.post[self.index[pattern]])


def fit_scorer(rows: list[dict[int, float]], target: np.ndarray, bits: int = FEATURE_BITS, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Logistic weights on the posteriors, the intercept last; classes weigh alike in total."""
    size = 1 << bits
    w, m1, m2 = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    if not rows:
        return w
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.fromiter((f for r in rows for f in r), np.int64, len(row))
    value = np.fromiter((v for r in rows for v in r.values()), float, len(row))
    weight = np.where(target >= 0.5, 0.5 / max(1, (target >= 0.5).sum()), 0.5 / max(1, (target < 0.5).sum()))
    for step in range(1, steps + 1):
        z = np.bincount(row, w[feature] * value, len(rows)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) * weight
        g = np.append(np.bincount(feature, error[row] * value, size), error.sum()) + decay * w
        m1 += 0.1 * (g - m1)
        m2 += 0.001 * (g * g - m2)
        w -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return w


def score_text(text: str | None, weights: np.ndarray, known: dict[str, int]) -> tuple[float, str]:
    s, words = statistics(text)
    f = hashed_features(s, words, known)
    z = float(weights[-1] + sum(weights[b] * v for b, v in f.items()))
    return 1 / (1 + np.exp(-max(-40.0, min(40.0, z)))), votes(s)


class QualityModel:
    def __init__(self, labels: LabelModel, weights: np.ndarray) -> None:
        self.labels, self.weights = labels, weights


@operator
def fit_quality(docs: DataFrame, *, text_col: str = "text", sample: int = 6_000) -> QualityModel:
    """Counts the vote patterns of all texts, then fits the scorer on about ``sample`` texts.

    The sample holds, with the smallest hash of the text, half texts whose votes hold a bad one and half others; only
    their hashes are broadcast, and equal texts count once. Every text is voted on once; votes are stored by hash.
    """
    hashed = docs.select(F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"))

    def make():
        return lambda x: {"pattern": [votes(statistics(t)[0]) for t in x["text"]], "h": x["h"]}

    voted, voted_at = store(map_texts(hashed, ["text", "h"], make, "pattern string, h bigint"))
    got = voted.groupBy("pattern").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("d")).collect()  # at most 3 ** labellers
    labels = LabelModel({r["pattern"]: r["n"] for r in got})

    def cutoff(bad: bool) -> int:
        share = min(1.0, sample / 2 / max(1, sum(r["d"] for r in got if ("b" in r["pattern"]) == bad)))
        return int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1

    chosen = voted.filter(F.col("h") <= F.when(F.col("pattern").contains("b"), F.lit(cutoff(True))).otherwise(F.lit(cutoff(False)))).dropDuplicates(["h"])

    def make_rows():
        known: dict[str, int] = {}

        def f(x):
            each = [hashed_features(*statistics(t), known) for t in x["text"]]
            return {"h": x["h"], "b": [list(e) for e in each], "v": [list(e.values()) for e in each], "p": x["pattern"]}

        return f

    near = hashed.join(F.broadcast(chosen), "h")  # about ``sample`` hashes
    rows = map_texts(near, ["text", "h", "pattern"], make_rows, "h bigint, b array<int>, v array<double>, p string").dropDuplicates(["h"]).orderBy("h").toArrow().to_pydict()
    drop_stored(docs.sparkSession, voted_at)
    features = [dict(zip(b, v, strict=True)) for b, v in zip(rows["b"], rows["v"], strict=True)]
    target = np.array([labels.posterior(p) for p in rows["p"]])
    return QualityModel(labels, fit_scorer(features, target))


@operator
def quality_scores(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: id, score (1: good), the posterior of its votes, the votes, and kept."""
    weights, labels = model.weights, model.labels

    def make():
        known: dict[str, int] = {}

        def f(x):
            got = [score_text(t, weights, known) for t in x[text_col]]
            return {"id": x[id_col], "score": [float(s) for s, _ in got], "posterior": [labels.posterior(p) if p in labels.index else None for _, p in got], "votes": [p for _, p in got]}

        return f

    kind = dict(docs.dtypes)[id_col]
    out = map_texts(docs, [id_col, text_col], make, f"id {kind}, score double, posterior double, votes string")
    return out.select(F.col("id").alias(id_col), "score", "posterior", "votes", (F.col("score") >= threshold).alias("kept"))


@operator
def keep_good(docs: DataFrame, model: QualityModel, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows with a score of ``threshold`` or more, with all their columns."""
    weights, at = model.weights, docs.columns.index(text_col)

    def make():
        known: dict[str, int] = {}
        return lambda batch: batch.filter(pa.array([score_text(t, weights, known)[0] >= threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return replace_batches(docs, make)
